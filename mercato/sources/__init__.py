from mercato.sources.bindings import stand_in_tables
from mercato.sources.files import (ConflictError, read_export, read_table, update_table,
                                   write_table)
from mercato.sources.schema import check_contract
from mercato.sources.tables import LazyTables, Tables

__all__ = ["ConflictError", "LazyTables", "Tables", "check_contract", "read_export", "read_table",
           "stand_in_tables", "update_table", "write_table"]
