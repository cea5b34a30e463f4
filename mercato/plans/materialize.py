"""Stored derived tables: the silver chain and the customer-score table.

The reference materialises its silver tables and the RFM score table with
CREATE OR REPLACE TABLE ... AS SELECT, and later statements read them back.
Here the same: each is written as a stored table on shared storage and
returned as a DataFrame over the stored files.  Reports that read the result
start from files, not from the whole lineage, which also bounds the work redone
after a lost executor.

Without a folder every call stores into a new one; with a folder the tables in
it are replaced, and what reads their earlier versions keeps working.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mercato.operators import quality, rfm, sellers
from mercato.session import ensure_checkpoint_dir
from mercato.sources import LazyTables, Tables, read_table, write_table

SILVER = ("items", "orders", "reviews")


def _stored(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    spark = df.sparkSession
    base = folder or (f"{ensure_checkpoint_dir(spark).rstrip('/')}/mercato-derived/"
                      f"{uuid.uuid4().hex}")
    write_table(df, f"{base}/{name}")
    return read_table(spark, f"{base}/{name}")


def store_silver(spark: SparkSession, t: Tables, folder: str | None = None) -> Tables:
    """D02 + D11 + D14 stored (S3) and read back (S4): the bundle with items,
    orders and reviews replaced by their stored silver forms."""
    silver = quality.silver(t)
    return t.with_(**{name: _stored(getattr(silver, name), folder, f"{name}_silver")
                      for name in SILVER})


def store_scores(spark: SparkSession, scores: DataFrame, folder: str | None = None) -> DataFrame:
    """H23's CREATE OR REPLACE of the score table, then the read-back that
    H24 starts from."""
    return _stored(scores, folder, "customer_score")


def with_derived(t: LazyTables, as_of: str) -> LazyTables:
    """The bundle with the silver tables, the score table and the months' seller bitmaps beside
    the sources; stage it to store each of them once (:func:`mercato.sources.staging.stage_tables`)."""
    return t.deriving(items_silver=lambda: quality.items_silver(t.items),
                      orders_silver=lambda: quality.orders_silver(t.orders),
                      reviews_silver=lambda: quality.reviews_silver(t.reviews),
                      scores=lambda: rfm.rfm_scores(t, as_of=as_of),
                      seller_months=lambda: sellers.seller_months(t))
