"""mercato: marketplace analytics as plain Spark DataFrame functions.

Every operator takes a :class:`mercato.sources.Tables` bundle (or a few
DataFrames) plus keyword parameters and returns a lazy DataFrame built only
from Spark joins, aggregates and windows.  Nothing is collected to the driver.
"""

from mercato.sources.tables import Tables

__all__ = ["Tables"]
