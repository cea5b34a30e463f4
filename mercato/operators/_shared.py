"""Building blocks shared by the operators.

Fact tables (items, reviews, payments) are reduced to the order grain before
they meet each other or the orders table.  That keeps every join one-to-one
(or one-to-few) per order: a hot order is collapsed by the partial aggregate
before the shuffle, and items never pair with reviews or payments row by row.
Dimension lookups (product -> category -> English name) happen after the
facts are aggregated to the product grain.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions import spread, spread_plan
from mercato.sources import Tables

DELIVERED = "delivered"
CANCELED = "canceled"
EN = "product_category_name_english"


def one() -> Column:
    return F.count(F.lit(1))


def per_order(t: Tables, part: Callable[[Tables], DataFrame], facts: Sequence[str] = ()) -> DataFrame:
    """``part(t)`` for rows that depend on the facts of one order each.

    Co-located facts (``mercato.sources.staging.stage_colocated``) come in parts that
    share no order: each part's rows are made apart, those of the bucketed part
    without a shuffle on ``order_id``, and put together.  Of other bundles ``facts``, the
    tables with an ``order_id`` that ``part`` reads, are cut in the same way where they are large
    (``mercato.functions.spreading``; this counts them).
    """
    parts = getattr(t, "parts", None)
    if not parts and facts:
        plan = spread_plan([getattr(t, n) for n in facts], "order_id")
        cut = [spread(getattr(t, n), "order_id", plan) for n in facts]
        parts = [t.with_(**dict(zip(facts, frames))) for frames in zip(*cut)]
    parts = parts or [t]
    return reduce(DataFrame.unionByName, [part(p) for p in parts])


def delivered_orders(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    return orders.filter(F.col("order_status") == status)


def category_lookup(t: Tables, translated: str = "left") -> DataFrame:
    """product_id -> native and English category.

    ``translated="inner"`` keeps only products whose category has a
    translation (inner join in the source SQL), ``"left"`` keeps the rest
    with a null English name.
    """
    return (t.products.select("product_id", "product_category_name")
            .join(t.translation.select("product_category_name", EN),
                  "product_category_name", translated))


def with_category(by_product: DataFrame, t: Tables, translated: str = "left",
                  products: str = "inner") -> DataFrame:
    """Attach categories to rows already aggregated by ``product_id``.

    ``products="left"`` keeps product ids missing from the products table
    (and null ids) with null categories, as a LEFT JOIN chain does.
    """
    look = category_lookup(t, translated)
    return by_product.join(look, "product_id", products)


def review_stats(reviews: DataFrame) -> DataFrame:
    """Per order: review rows, non-null ids and scores, and score sum."""
    return reviews.groupBy("order_id").agg(
        one().alias("rv_rows"),
        F.count("review_id").alias("rv_ids"),
        F.count("review_score").alias("rv_scores"),
        F.sum("review_score").alias("rv_score_sum"),
    )


def pair_factor(rows_col: str = "rv_rows") -> Column:
    """Rows a left-joined item row turns into: one per review, or one."""
    return F.coalesce(F.col(rows_col), F.lit(1))
