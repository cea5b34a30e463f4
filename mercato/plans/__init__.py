from mercato.plans.catalog import REPORTS

__all__ = ["REPORTS"]
