"""Customers: lifetime value, most valuable customers, repeat-purchase
span, new customers per month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import as_double, asc, desc, elapsed_days, exact_mean, round_money, sentinel
from mercato.operators._shared import DELIVERED
from mercato.sources import Tables

DAYS_PER_YEAR = 365.25


def _person_orders(t: Tables) -> DataFrame:
    return t.customers.select("customer_id", "customer_unique_id").join(
        t.orders.select("customer_id", "order_id", "order_status", "order_purchase_timestamp"),
        "customer_id")


def customer_lifetime_value(items_s: DataFrame, orders_s: DataFrame, t: Tables | None = None,
                            grain: str = "customer_id") -> DataFrame:
    """Per customer the first and last approval, days between their
    dates, revenue, distinct approval times, and a yearly value estimate
    (revenue if all on one day, else revenue per day x 365.25).

    ``grain="customer_unique_id"`` groups by person instead of by the
    per-order ``customer_id`` (which never sees a repeat purchase).
    """
    ts = F.col("order_approved_at")
    dtype = orders_s.schema["order_approved_at"].dataType
    o = orders_s.filter(ts.isNotNull() & (ts != sentinel(dtype))).select(
        "order_id", "customer_id", "order_approved_at")
    if grain != "customer_id":
        o = o.join(t.customers.select("customer_id", grain), "customer_id")
    per = items_s.groupBy("order_id").agg(F.sum("price").alias("rev"))
    m = (o.join(per, "order_id").groupBy(grain)
         .agg(F.min(ts).alias("first_order_time"), F.max(ts).alias("last_order_time"),
              F.round(F.sum("rev"), 2).alias("_rev"),
              F.count_distinct(ts).alias("customer_total_orders")))
    lt = F.datediff(F.to_date("last_order_time"), F.to_date("first_order_time"))
    rev = F.col("_rev").cast("double")
    clv = F.when(F.col("lt_days") == 0, rev).otherwise(rev / F.col("lt_days") * DAYS_PER_YEAR)
    return (m.withColumn("lt_days", lt)
            .select(grain, "first_order_time", "last_order_time", "lt_days",
                    rev.alias("customer_total_revenue"), "customer_total_orders",
                    F.round(clv, 2).alias("clv_estimated_yearly_brut"))
            .orderBy(desc("clv_estimated_yearly_brut"), asc(grain)))


def most_valuable_customers(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Payment total per person over orders with ``status``."""
    o = t.orders.filter(F.col("order_status") == status).select(
        "order_id", "customer_id", "order_status")
    pay = t.payments.groupBy("order_id").agg(F.sum("payment_value").alias("s"))
    j = o.join(pay, "order_id").join(
        t.customers.select("customer_id", "customer_unique_id"), "customer_id")
    return (j.groupBy("customer_unique_id", "order_status")
            .agg(as_double(F.sum("s")).alias("Total_Payment"))
            .select("customer_unique_id", "Total_Payment",
                    F.col("order_status").alias("Order_Status"))
            .orderBy(desc("Total_Payment"), asc("customer_unique_id")))


def repeat_purchase_gap(t: Tables) -> DataFrame:
    """Mean whole days from first to last purchase of persons with more
    than one order (a span, not the gap between neighbouring orders)."""
    per = (_person_orders(t).groupBy("customer_unique_id")
           .agg(F.min("order_purchase_timestamp").alias("first_order"),
                F.max("order_purchase_timestamp").alias("last_order"),
                F.count("order_id").alias("n"))
           .filter(F.col("n") > 1))
    return per.agg(F.round(F.avg(elapsed_days("first_order", "last_order")), 1)
                   .alias("AVG_DAY_BETWEEN_ORDERS"))


def new_customers_monthly(t: Tables) -> DataFrame:
    """Persons by year and month of their first purchase."""
    first = _person_orders(t).groupBy("customer_unique_id").agg(
        F.min("order_purchase_timestamp").alias("first_order_date"))
    ts = F.col("first_order_date")
    return (first.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month"))
            .agg(F.count("customer_unique_id").alias("new_customers"))
            .orderBy("year", "month"))


def average_clv(t: Tables) -> DataFrame:
    """Mean over persons of their item total (price + freight)."""
    per_order = t.items.groupBy("order_id").agg(
        F.sum(F.col("price") + F.col("freight_value")).alias("s"))
    per_person = (_person_orders(t).join(per_order, "order_id")
                  .groupBy("customer_unique_id").agg(F.sum("s").alias("total_revenue")))
    return per_person.agg(round_money(exact_mean(F.sum("total_revenue"),
                                                 F.count("total_revenue"))).alias("CLV"))

