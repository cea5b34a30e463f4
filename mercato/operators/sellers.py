"""Marketplace: active sellers, category mix, activity and cancellations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions import asc, desc, rank_ranged, rate_percent, spread, spread_plan, top_k
from mercato.operators._shared import CANCELED, EN, delivered_orders, one, per_order, with_category
from mercato.sources import Tables


def active_sellers(t: Tables) -> DataFrame:
    """Sellers that appear on at least one item row."""
    ids = t.items.select("seller_id").distinct()
    return (t.sellers.select("seller_id").join(ids, "seller_id")
            .agg(F.count_distinct("seller_id").alias("counter_seller")))


def seller_category_mix(t: Tables, k: int = 50) -> DataFrame:
    """Item rows per seller and category, with the seller's total items
    and number of (non-null) categories."""
    by_sp = [p.groupBy("seller_id", "product_id").agg(F.count("order_item_id").alias("n"))
             for p in spread(t.items, "product_id", spread_plan([t.items], "product_id"))]
    named = reduce(DataFrame.unionByName, [with_category(p, t, translated="left", products="left")
                                           .select("seller_id", EN, "n") for p in by_sp])
    # At most one row per category within a seller: small window partitions.
    w = Window.partitionBy("seller_id")

    def mixed(rows: DataFrame) -> DataFrame:
        by_cat = rows.groupBy("seller_id", EN).agg(F.sum("n").alias("items_in_this_category"))
        mix = t.sellers.select("seller_id", "seller_state").join(by_cat, "seller_id")
        return mix.select(
            "seller_id", "seller_state", EN, "items_in_this_category",
            F.sum("items_in_this_category").over(w).alias("total_items_by_seller"),
            F.count(EN).over(w).alias("total_categories_by_seller"))

    sellers = spread(named, "seller_id", spread_plan([t.items], "seller_id"))
    out = reduce(DataFrame.unionByName, [mixed(p) for p in sellers])
    return top_k(out, k, [desc("total_items_by_seller"), asc("seller_id"),
                          desc("items_in_this_category"), asc(EN)])


def _seller_rows(t: Tables) -> DataFrame:
    """(sale_year, sale_month, seller_id, n): item rows of a seller in a delivered order
    with an approval time."""
    ts = F.col("order_approved_at")

    def rows(t: Tables) -> DataFrame:
        o = (delivered_orders(t.orders).filter(ts.isNotNull())
             .select("order_id", F.year(ts).alias("sale_year"), F.month(ts).alias("sale_month")))
        per = t.items.groupBy("order_id", "seller_id").agg(one().alias("n"))
        return o.join(per, "order_id")

    return per_order(t, rows, ("orders", "items"))


def seller_activity_monthly(t: Tables) -> DataFrame:
    """Distinct sellers and item rows per approval month of delivered
    orders ("orders" counts item rows, as written)."""
    return (_seller_rows(t).groupBy("sale_year", "sale_month")
            .agg(F.count_distinct("seller_id").alias("distinct_active_sellers"),
                 F.sum("n").alias("total_orders_approved_in_month"))
            .orderBy("sale_year", "sale_month"))


def seller_months(t: Tables) -> DataFrame:
    """(sale_year, sale_month, bucket, sellers, n): H07's months in a form that merges.

    Sellers are numbered without gaps; ``sellers`` is the bitmap of those seen among the
    numbers of ``bucket`` (32 768 each, 4 KB), ``n`` their item rows.  Rows without a seller
    have a null bucket and an empty bitmap.  Stored once, it gives distinct sellers of
    any set of months from a few rows for each month; numbers are of this table
    alone.  Runs the job of :func:`mercato.functions.rank_ranged` when called.
    """
    ids = t.items.select("seller_id").where("seller_id IS NOT NULL").distinct()
    numbers = rank_ranged(ids, [("seller_id", False)], "number")
    seen = reduce(DataFrame.unionByName, [
        p.groupBy("sale_year", "sale_month", "seller_id").agg(F.sum("n").alias("n"))
        .join(numbers, "seller_id", "left")
        for p in spread(_seller_rows(t), "seller_id", spread_plan([t.items], "seller_id"))])
    return (seen.groupBy("sale_year", "sale_month", F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("sellers"),
                 F.sum("n").alias("n")))


def merged_activity(months: DataFrame, *period: Column, rows: str) -> DataFrame:
    """Distinct sellers and item rows (named ``rows``) for each period of stored
    :func:`seller_months`, exact for any period made of whole months."""
    names = [f"_p{i}" for i in range(len(period))]
    cut = months.select(*(p.alias(n) for p, n in zip(period, names)), "bucket", "sellers", "n")
    merged = cut.groupBy(*names, "bucket").agg(
        F.bitmap_or_agg("sellers").alias("sellers"), F.sum("n").alias("n"))
    out = merged.groupBy(*names).agg(
        F.sum(F.bitmap_count("sellers")).alias("distinct_active_sellers"), F.sum("n").alias(rows))
    return out.orderBy(*names).select(
        *(F.col(n).alias(out_name) for n, out_name in zip(names, _names(months, period))),
        "distinct_active_sellers", rows)


def _names(df: DataFrame, columns: Sequence[Column]) -> list[str]:
    return df.select(*columns).columns


def activity_by_month(months: DataFrame) -> DataFrame:
    """H07 from stored bitmaps."""
    return merged_activity(months, F.col("sale_year"), F.col("sale_month"),
                           rows="total_orders_approved_in_month")


def activity_by_quarter(months: DataFrame) -> DataFrame:
    """H07's figures for each quarter: the months' bitmaps merged, no fact read again."""
    quarter = F.ceil(F.col("sale_month") / 3).cast("int").alias("sale_quarter")
    return merged_activity(months, F.col("sale_year"), quarter,
                           rows="total_orders_approved_in_quarter")


def category_volume_monthly(t: Tables) -> DataFrame:
    """Item rows per purchase month and English category (delivered)."""
    ts = F.col("order_purchase_timestamp")

    def rows(t: Tables) -> DataFrame:
        o = delivered_orders(t.orders).select(
            "order_id", F.year(ts).alias("sale_year"), F.month(ts).alias("sale_month"))
        per = t.items.groupBy("order_id", "product_id").agg(F.count("order_item_id").alias("n"))
        return o.join(per, "order_id")

    by_product = (per_order(t, rows, ("orders", "items"))
                  .groupBy("sale_year", "sale_month", "product_id").agg(F.sum("n").alias("n")))
    return (with_category(by_product, t, translated="left")
            .groupBy("sale_year", "sale_month", EN)
            .agg(F.sum("n").alias("items_sold_in_category"))
            .orderBy("sale_year", "sale_month", desc("items_sold_in_category"), asc(EN)))


def _seller_order_rows(t: Tables) -> DataFrame:
    def rows(t: Tables) -> DataFrame:
        per = t.items.groupBy("order_id", "seller_id").agg(one().alias("n"))
        return per.join(t.orders.select("order_id", "order_status"), "order_id")

    return per_order(t, rows, ("orders", "items"))


def seller_cancellations(t: Tables, k: int = 10) -> DataFrame:
    """Item rows of canceled orders per seller."""
    j = _seller_order_rows(t).filter(F.col("order_status") == CANCELED)
    out = j.groupBy("seller_id").agg(F.sum("n").alias("total_cancellations"))
    return top_k(out, k, [desc("total_cancellations"), asc("seller_id")])


def seller_cancellation_rate(t: Tables, min_handled: int = 10, k: int = 10) -> DataFrame:
    """Canceled share of each seller's item rows (sellers with at least
    ``min_handled`` rows), highest rate first."""
    j = _seller_order_rows(t)
    canceled = F.when(F.col("order_status") == CANCELED, F.col("n")).otherwise(F.lit(0))
    out = (j.groupBy("seller_id")
           .agg(F.sum("n").alias("total_orders_handled"),
                F.sum(canceled).alias("total_canceled_orders"))
           .filter(F.col("total_orders_handled") >= min_handled)
           .withColumn("cancellation_rate_percent",
                       rate_percent(F.col("total_canceled_orders"), F.col("total_orders_handled"))))
    return top_k(out, k, [desc("cancellation_rate_percent"), desc("total_orders_handled"),
                          asc("seller_id")])
