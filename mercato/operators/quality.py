"""Data preparation and quality: key audits, de-duplication, null handling.

Silver tables: ``items_silver`` (one item per order), ``orders_silver``
(missing approval time replaced by a sentinel) and ``reviews_silver`` (first
review per order).  They are lazy; store them with
:func:`mercato.sources.write_table` when several reports read them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions import (first_per_key, key_audit, key_count, local_date,
                               null_profile, sentinel, timestamp_text)
from mercato.functions.dates import DEFAULT_ZONE
from mercato.sources import Tables, read_table, update_table

# Total order that decides which item survives de-duplication.  The source
# leaves the survivor arbitrary; we keep the lowest item number.
ITEM_ORDER = ("order_item_id", "product_id", "seller_id", "price", "freight_value",
              "shipping_limit_date")
ORDER_COLUMNS = ("order_id", "customer_id", "order_status", "order_purchase_timestamp",
                 "order_approved_at", "order_delivered_carrier_date",
                 "order_delivered_customer_date")


def items_key_count(t: Tables) -> DataFrame:
    """Item rows against distinct orders."""
    return key_count(t.items, "order_id")


def items_silver(items: DataFrame, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    """One item row per order."""
    return first_per_key(items, ["order_id"], [F.col(c).asc_nulls_last() for c in order])


def items_negative_price(items_s: DataFrame, below: float = 0) -> DataFrame:
    """Rows with a price under ``below`` (under 0 expected: none)."""
    return items_s.filter(F.col("price") < below)


def items_null_profile(items_s: DataFrame, columns: Sequence[str] = ("price", "seller_id")) -> DataFrame:
    """Null counts of the given columns."""
    return null_profile(items_s, columns)


def null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D04 / D15 in row form: the rows with a null in any of the columns."""
    return df.filter(reduce(or_, (F.col(c).isNull() for c in columns)))


def items_silver_pk_audit(items_s: DataFrame) -> DataFrame:
    """Is ``order_id`` a key of the silver items?"""
    return key_audit(items_s, "order_id")


def items_local_date(items_s: DataFrame, zone: str = DEFAULT_ZONE,
                     name: str = "istanbul_tarihi") -> DataFrame:
    """Every column plus the date of ``shipping_limit_date`` in ``zone``."""
    dtype = items_s.schema["shipping_limit_date"].dataType
    return items_s.withColumn(name, local_date("shipping_limit_date", zone, dtype))


def orders_duplicate_rows(orders: DataFrame) -> DataFrame:
    """Order rows beyond the first per ``order_id`` (expected: none).

    "First" is the smallest row in column order.  Written without a window
    so a key repeated millions of times is not sorted in one task: keys seen
    more than once are found by an aggregate, their first row by a
    (partially aggregated) ``min`` per key, and ``exceptAll`` removes one
    copy of it, grouping on all columns.
    """
    rest = [c for c in orders.columns if c != "order_id"]
    repeated = (orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"))
                .filter("_n > 1").select("order_id"))
    dup = orders.join(repeated, "order_id", "left_semi")
    first = (dup.groupBy("order_id").agg(F.min(F.struct(*rest)).alias("_f"))
             .select("order_id", *[F.col(f"_f.{c}").alias(c) for c in rest]))
    return dup.exceptAll(first.select(*orders.columns))


def orders_pk_audit(t: Tables) -> DataFrame:
    """Is ``order_id`` a key of the orders?"""
    return key_audit(t.orders, "order_id")


def orders_null_status(t: Tables, column: str = "order_status") -> DataFrame:
    """Orders without a status (expected: none), or without another column."""
    return t.orders.filter(F.col(column).isNull())


def orders_null_approved(t: Tables) -> DataFrame:
    """Orders never approved."""
    return t.orders.filter(F.col("order_approved_at").isNull())


def orders_silver(orders: DataFrame) -> DataFrame:
    """D11 (and S5): missing approval time set to the sentinel date."""
    dtype = orders.schema["order_approved_at"].dataType
    return orders.withColumn(
        "order_approved_at", F.coalesce(F.col("order_approved_at"), sentinel(dtype)))


def fill_missing_approval(spark: SparkSession, path: str) -> int:
    """The same as an UPDATE of a stored orders table: only files that hold an
    order without approval time are rewritten.  Returns their number."""
    dtype = read_table(spark, path).schema["order_approved_at"].dataType
    return update_table(spark, path, F.col("order_approved_at").isNull(),
                        {"order_approved_at": sentinel(dtype)})


def orders_approved_label(t: Tables, unknown: str = "UNKNOWN") -> DataFrame:
    """Approval time as text, ``UNKNOWN`` where missing."""
    dtype = t.orders.schema["order_approved_at"].dataType
    label = F.coalesce(timestamp_text("order_approved_at", dtype), F.lit(unknown))
    return t.orders.withColumn("order_approved_at", label)


def reviews_key_count(t: Tables) -> DataFrame:
    """Review rows against distinct orders."""
    return key_count(t.reviews, "order_id")


def reviews_duplicate_profile(t: Tables) -> DataFrame:
    """How many orders have 1, 2, 3 ... review rows."""
    per_order = t.reviews.groupBy("order_id").agg(F.count(F.lit(1)).alias("reviews_per_order"))
    return per_order.groupBy("reviews_per_order").agg(F.count(F.lit(1)).alias("order_count"))


def reviews_silver(reviews: DataFrame) -> DataFrame:
    """The first review (lowest ``review_id``) of each order."""
    return first_per_key(reviews, ["order_id"], [F.col("review_id").asc_nulls_last()])


def reviews_null_profile(reviews_s: DataFrame,
                         columns: Sequence[str] = ("order_id", "review_score",
                                                   "review_creation_date",
                                                   "review_answer_timestamp")) -> DataFrame:
    """Null counts of the silver reviews."""
    return null_profile(reviews_s, columns)


def reviews_silver_pk_audit(reviews_s: DataFrame) -> DataFrame:
    """Is ``order_id`` a key of the silver reviews?"""
    return key_audit(reviews_s, "order_id")


def customers_pk_audit(t: Tables) -> DataFrame:
    """Is ``customer_id`` a key of the customers?"""
    return key_audit(t.customers, "customer_id")


def raw_orders_repeat_check(t: Tables) -> DataFrame:
    """Order rows against distinct ``customer_id`` (equal: no repeats)."""
    return key_count(t.orders, "customer_id")


def silver(t: Tables) -> Tables:
    """The bundle with items, orders and reviews replaced by their silver forms."""
    return t.with_(items=items_silver(t.items), orders=orders_silver(t.orders),
                   reviews=reviews_silver(t.reviews))
