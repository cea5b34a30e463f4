"""RFM: recency, frequency and monetary scores with segments.

Per customer: calendar days since the last delivered purchase (as of a
date), distinct delivered orders, item revenue.  Each measure is scored 1-5
against its 20/40/60/80 % quantiles, scores are joined into a code like ``555``
and mapped to a segment, first matching rule wins.

The quantiles are exact at every size: a mergeable sketch bounds each of them from
below and above, rows outside the bounds are only counted, and the value at a rank is
found from the running sums of the few distinct values between the bounds.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions import as_double, asc, spread, spread_plan, top_k
from mercato.operators._shared import delivered_orders, per_order
from mercato.sources import Tables

FIFTHS = (1, 2, 3, 4)
# The sketch that bounds each threshold (rank error at most 1 / accuracy), and how many
# such errors its bounds keep away: at most 0.4 % of the rows (and ties) lie between bounds.
BRACKET_ACCURACY, MARGIN = 10_000, 4
# For thresholds="sketch": relative rank error 1 / accuracy.
SKETCH_ACCURACY = 100_000

# Segment labels in rule order, as the reports show them.
BEST = "En Iyi Müşteri"
LOYAL = "Sadık Müşteriler"
NEW = "Yeni Müşteriler"
HIGH_VALUE_AT_RISK = "Yüksek Değerli Kayıp Riskli"
LOST = "Kayıp Müşteriler"
POTENTIAL_LOYAL = "Potansiyel Sadık Müşteriler"
NEEDS_ATTENTION = "Dikkat Gerektirenler"
OTHER = "Diger"


def rfm_metrics(t: Tables, as_of: str | _dt.date | None = None,
                grain: str = "customer_id") -> DataFrame:
    """Recency (days), frequency (orders), monetary (decimal) per ``grain``."""
    def rows(t: Tables) -> DataFrame:
        o = delivered_orders(t.orders).select("order_id", "customer_id", "order_purchase_timestamp")
        per = t.items.groupBy("order_id").agg(F.sum("price").alias("rev"))
        return o.join(per, "order_id")

    orders = per_order(t, rows, ("orders", "items"))
    if grain == "customer_id":
        parts = spread(orders, grain, spread_plan([t.orders], grain))
    else:
        parts = [orders.join(t.customers.select("customer_id", grain), "customer_id")]
    today = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    # One row per order here (items pre-aggregated, order_id audited as the
    # orders key), so COUNT(DISTINCT order_id) is a plain count: no extra shuffle.
    return reduce(DataFrame.unionByName, [
        p.groupBy(grain)
        .agg(F.datediff(today, F.to_date(F.max("order_purchase_timestamp"))).alias("recency"),
             F.count("order_id").alias("frequency"),
             F.sum("rev").alias("monetary")) for p in parts])


def _sketched(metrics: DataFrame, columns: dict[str, Column], accuracy: int) -> Column:
    """A struct of threshold arrays from mergeable quantile sketches (approximate)."""
    fr = F.array(*[F.lit(k / 5) for k in FIFTHS])
    return metrics.select(F.struct(*[
        F.percentile_approx(c, fr, accuracy).alias(name) for name, c in columns.items()
    ])).scalar()


def exact_thresholds(metrics: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row with a struct of threshold arrays, one field per measure: the
    smallest value with at least k fifths of all rows at or below it."""
    pairs = F.array(*[F.struct(F.lit(name).alias("m"), c.cast("double").alias("v"))
                      for name, c in columns.items()])
    values = (metrics.select(F.explode(pairs).alias("p")).select("p.m", "p.v")
              .where("v IS NOT NULL"))
    # a low and a high bound around each threshold, from a sketch: a row per measure
    near = F.array(*[F.lit(k / 5 + d * MARGIN / BRACKET_ACCURACY) for k in FIFTHS for d in (-1, 1)])
    cuts = values.groupBy("m").agg(F.percentile_approx("v", near, BRACKET_ACCURACY).alias("cuts"))
    # ranges in ascending order: the gap below a threshold's bounds (even), between them (odd)
    passed = sum((F.when(F.col("cuts")[2 * j + 1] < F.col("v"), 1).otherwise(0)
                  for j in range(len(FIFTHS))), F.lit(0))
    between = F.coalesce(F.get("cuts", 2 * F.col("passed")) <= F.col("v"), F.lit(False))
    ranged = (values.join(F.broadcast(cuts), "m").select("m", "v", "cuts", passed.alias("passed"))
              .select("m", "v", (2 * F.col("passed") + between.cast("int")).alias("r")))
    # a gap needs only its row count; values between bounds are counted one by one
    counts = (ranged.groupBy("m", "r", F.when(F.col("r") % 2 == 1, F.col("v")).alias("v"))
              .agg(F.count(F.lit(1)).alias("n")))
    upto = Window.partitionBy("m").orderBy("r")
    sums = (counts.groupBy("m", "r").agg(F.sum("n").alias("s"))
            .withColumn("end", F.sum("s").over(upto))
            .withColumn("total", F.sum("s").over(Window.partitionBy("m"))))
    rank = F.ceil(F.col("total") * F.col("k") / 5)
    hit = (sums.withColumn("k", F.explode(F.array(*[F.lit(k) for k in FIFTHS])))
           .withColumn("rank", rank).where("end >= rank AND end - s < rank")
           .select("m", "r", "k", (F.col("rank") - F.col("end") + F.col("s")).alias("left")))
    within = Window.partitionBy("m", "k").orderBy("v")
    # the sketch's error is below the margin, so a rank never falls in a gap; if it did, fail
    value = F.when(F.col("r") % 2 == 1, F.col("v")).otherwise(
        F.raise_error(F.lit("a quantile lies outside its sketched bounds")).cast("double"))
    found = (counts.join(F.broadcast(hit), ["m", "r"])
             .withColumn("run", F.sum("n").over(within)).where(F.col("run") >= F.col("left"))
             .groupBy("m", "k").agg(F.min(value).alias("v")))
    pick = lambda name, k: F.min(F.when((F.col("m") == name) & (F.col("k") == k), F.col("v")))
    return found.agg(F.struct(*[F.array(*[pick(name, k) for k in FIFTHS]).alias(name)
                                for name in columns]).alias("q"))


def _low_is_good(x: Column, q: Column) -> Column:
    return (F.when(x <= q[0], 5).when(x <= q[1], 4).when(x <= q[2], 3)
            .when(x <= q[3], 2).otherwise(1))


def _high_is_good(x: Column, q: Column) -> Column:
    return (F.when(x >= q[3], 5).when(x >= q[2], 4).when(x >= q[1], 3)
            .when(x >= q[0], 2).otherwise(1))


def segment(r: Column, f: Column, m: Column) -> Column:
    return (F.when((r == 5) & (f == 5) & (m == 5), BEST)
            .when((r >= 4) & (f >= 4) & (m >= 4), LOYAL)
            .when((r == 5) & f.between(1, 3), NEW)
            .when((r <= 2) & (f >= 5) & (m >= 4), HIGH_VALUE_AT_RISK)
            .when((r <= 2) & (f <= 2) & (m <= 2), LOST)
            .when(r.between(3, 4) & f.between(3, 4), POTENTIAL_LOYAL)
            .when((r <= 3) & (f >= 3) & (m >= 3), NEEDS_ATTENTION)
            .otherwise(OTHER))


def rfm_scores(t: Tables, as_of: str | _dt.date | None = None, grain: str = "customer_id",
               thresholds: str = "exact", accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """The customer-score table (one row per ``grain``).

    ``thresholds="sketch"`` takes approximate quantiles instead: one pass less,
    but scores next to a threshold may differ above ``accuracy`` customers."""
    m = rfm_metrics(t, as_of, grain)
    money = F.col("monetary").cast("double")
    measures = {"r": F.col("recency"), "f": F.col("frequency"), "m": money}
    q = (_sketched(m, measures, accuracy) if thresholds == "sketch"
         else exact_thresholds(m, measures).scalar())
    rq, fq, mq = q["r"], q["f"], q["m"]
    r, f, mm = (_low_is_good(F.col("recency"), rq), _high_is_good(F.col("frequency"), fq),
                _high_is_good(money, mq))
    scored = m.select(grain, "recency", "frequency", as_double(F.col("monetary")).alias("monetary"),
                      r.alias("r_score"), f.alias("f_score"), mm.alias("m_score"))
    code = F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")])
    return scored.select(
        "*", code.alias("RFM_Score"),
        segment(F.col("r_score"), F.col("f_score"), F.col("m_score")).alias("RFM_segment"))


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Customers per segment and code (a summary of the score table)."""
    return (scores.groupBy("RFM_segment", "RFM_Score")
            .agg(F.count(F.lit(1)).alias("customers")))


def best_customer_payments(scores: DataFrame, t: Tables, code: str = "555",
                           k: int = 10) -> DataFrame:
    """The payments of ``k`` orders of customers with score ``code``.

    The source takes any ``k`` rows; here the first by customer and order.
    """
    best = scores.filter(F.col("RFM_Score") == code).join(t.orders, "customer_id")
    sub = top_k(best, k, [asc("customer_id"), asc("order_id")])
    # at most k rows: a proven bound, so the payments are never shuffled
    return t.payments.join(F.broadcast(sub), "order_id")
