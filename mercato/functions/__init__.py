from mercato.functions.audit import key_audit, key_count, null_profile
from mercato.functions.dates import (SENTINEL, calendar_days, elapsed_days, elapsed_seconds,
                                     local_date, sentinel, timestamp_text, week_label,
                                     year_month)
from mercato.functions.money import (as_double, exact_mean, rate_percent, ratio_units,
                                     round_money, units_mean)
from mercato.functions.ranking import (asc, desc, first_per_key, rank_in_groups, rank_ranged,
                                       top_k, top_k_per_group)
from mercato.functions.spreading import spread, spread_plan

__all__ = [
    "SENTINEL", "as_double", "asc", "calendar_days", "desc", "elapsed_days",
    "elapsed_seconds", "exact_mean", "first_per_key", "key_audit", "key_count",
    "local_date", "null_profile", "rank_in_groups", "rank_ranged", "rate_percent", "ratio_units", "round_money",
    "sentinel", "spread", "spread_plan", "timestamp_text", "top_k", "top_k_per_group", "units_mean", "week_label", "year_month",
]
