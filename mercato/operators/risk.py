"""Risk and anomaly: price, freight and order-value outliers, slow
deliveries, approval latency, low-price repeat buyers.

A mean "over all rows" is a one-row aggregate used as a scalar subquery:
Spark runs it once and inlines the value, so no row is pulled into a single
task and nothing is cross-joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import (as_double, asc, desc, elapsed_days, elapsed_seconds, exact_mean,
                               round_money, top_k)
from mercato.operators._shared import CANCELED, delivered_orders
from mercato.sources import Tables

EXCLUDED_REPEAT_STATUSES = (CANCELED, "unavailable")


def mean_of(df: DataFrame, column: str):
    """The mean of a money column as a double scalar (sum is exact)."""
    return df.agg(
        (F.sum(column).cast("double") / F.count(column)).alias("mean")).scalar()


def ratio_to_mean(df: DataFrame, column: str, name: str):
    return (F.col(column).cast("double") / mean_of(df, column)).alias(name)


def price_outliers(t: Tables, k: int = 10) -> DataFrame:
    """Item rows with the highest price / mean price."""
    out = t.items.select("order_id", "price",
                         ratio_to_mean(t.items, "price", "price_vs_avg_ratio"))
    return top_k(out, k, [desc("price_vs_avg_ratio"), asc("order_id")])


def freight_outliers(t: Tables, k: int = 10) -> DataFrame:
    """Item rows with the highest freight / mean freight."""
    out = t.items.select("order_id", "price", "freight_value",
                         ratio_to_mean(t.items, "freight_value", "freight_vs_avg_ratio"))
    return top_k(out, k, [desc("freight_vs_avg_ratio"), asc("order_id"), asc("price")])


def slowest_deliveries(t: Tables, k: int = 10) -> DataFrame:
    """Delivered orders with the most whole days from purchase to
    delivery."""
    out = delivered_orders(t.orders).select(
        "order_id", "order_purchase_timestamp", "order_delivered_customer_date",
        elapsed_days("order_purchase_timestamp", "order_delivered_customer_date")
        .alias("delivery_duration_days"))
    return top_k(out, k, [desc("delivery_duration_days"), asc("order_id")])


def approval_latency(t: Tables, k: int = 100, fastest_first: bool = False) -> DataFrame:
    """Item rows of approved orders by seconds from purchase to approval.

    As written the slowest come first; ``fastest_first=True`` gives the
    order its comment describes.  The first ``k`` rows can only come from
    the first ``k`` orders (in the same order) that have items and a customer,
    so those candidates, at most ``k`` rows with their city and state, are found
    first and broadcast against the items: of the items only the distinct order
    ids are shuffled.
    """
    first = asc if fastest_first else desc
    secs = elapsed_seconds("order_purchase_timestamp", "order_approved_at")
    o = t.orders.filter(F.col("order_approved_at").isNotNull()).select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp",
        "order_approved_at", secs.alias("approval_duration_seconds"))
    with_items = o.join(t.items.select("order_id").distinct(), "order_id", "left_semi")
    placed = with_items.join(
        t.customers.select("customer_id", "customer_city", "customer_state"), "customer_id")
    candidates = top_k(placed, k, [first("approval_duration_seconds"), asc("order_id")])
    j = t.items.select("order_id", "price").join(F.broadcast(candidates), "order_id")
    out = j.select("order_id", "order_status", "order_purchase_timestamp", "order_approved_at",
                   "approval_duration_seconds", "price", "customer_city", "customer_state")
    return top_k(out, k, [first("approval_duration_seconds"), asc("order_id"), asc("price")])


def low_price_repeat_buyers(t: Tables, min_orders: int = 2,
                            max_avg_price: float = 100) -> DataFrame:
    """Persons with at least ``min_orders`` orders (not canceled or
    unavailable) whose rounded mean item price is below ``max_avg_price``."""
    o = t.orders.filter(~F.col("order_status").isin(*EXCLUDED_REPEAT_STATUSES)).select(
        "order_id", "customer_id")
    per = t.items.groupBy("order_id").agg(F.sum("price").alias("s"), F.count("price").alias("n"))
    j = per.join(o, "order_id").join(
        t.customers.select("customer_id", "customer_unique_id"), "customer_id")
    # one row per order (items pre-aggregated): distinct count == count
    out = (j.groupBy("customer_unique_id")
           .agg(F.count("order_id").alias("total_orders"),
                round_money(exact_mean(F.sum("s"), F.sum("n"))).alias("average_item_price"),
                round_money(F.sum("s")).alias("total_revenue_from_customer"))
           .filter((F.col("total_orders") >= min_orders)
                   & (F.col("average_item_price") < max_avg_price)))
    return out.orderBy(desc("total_orders"), asc("average_item_price"), asc("customer_unique_id"))


def order_value_outliers(t: Tables, k: int = 10) -> DataFrame:
    """Orders whose item total (price + freight) is largest relative to
    the mean order total; sorted by the rounded ratio, then total, then id."""
    totals = t.items.groupBy("order_id").agg(
        F.sum(F.col("price") + F.col("freight_value")).alias("total_order_price"))
    j = t.orders.select("order_id", "customer_id", "order_status").join(totals, "order_id")
    mean = mean_of(j, "total_order_price")
    out = j.select(
        "order_id", "customer_id", "order_status",
        as_double(F.col("total_order_price")).alias("total_order_price"),
        F.round(mean, 2).alias("overall_avg_order_price"),
        F.round(F.col("total_order_price").cast("double") / mean, 2).alias("price_vs_avg_ratio"))
    return top_k(out, k, [desc("price_vs_avg_ratio"), desc("total_order_price"), asc("order_id")])
