"""Key audits and null profiles: one-row aggregates, one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_count(df: DataFrame, key: str) -> DataFrame:
    """Rows and distinct values of ``key``."""
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.count_distinct(key).alias(f"distinct_{key}"))


def key_audit(df: DataFrame, key: str) -> DataFrame:
    """Could ``key`` be a primary key?  Rows, distinct, nulls, verdict.

    Replaces an unenforced PRIMARY KEY declaration: the check runs whenever
    new data arrives.
    """
    out = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(key).alias("distinct_keys"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
    )
    return out.withColumn(
        "is_key", (F.col("row_count") == F.col("distinct_keys")) & (F.col("null_keys") == 0))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: number of nulls per column, named ``null_<column>``."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])
