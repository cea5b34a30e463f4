"""Geography: revenue by state, top categories per place, seller-customer
flows, cancellation by state, state service profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import (as_double, asc, desc, elapsed_days, rate_percent, ratio_units,
                               round_money, top_k_per_group, units_mean)
from mercato.operators._shared import (CANCELED, EN, category_lookup, delivered_orders, one,
                                       per_order)
from mercato.sources import Tables

# The labels of the flow report.
SAME_STATE, OTHER_STATE = "Ayni Eyalet Icinde", "Farkli Eyaletler Arasi"
SAME_CITY, OTHER_CITY = "Ayni Sehir Icinde", "Farkli Sehirler Arasi"


def _order_places(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    o = (t.orders if orders is None else orders).select("order_id", "customer_id")
    return o.join(t.customers.select("customer_id", "customer_state", "customer_city"),
                  "customer_id")


def revenue_by_seller_state(t: Tables) -> DataFrame:
    """Delivered revenue per seller state."""
    def rows(t: Tables) -> DataFrame:
        d = delivered_orders(t.orders).select("order_id")
        per = t.items.groupBy("order_id", "seller_id").agg(F.sum("price").alias("rev"))
        return per.join(d, "order_id", "left_semi")

    by_seller = per_order(t, rows).groupBy("seller_id").agg(F.sum("rev").alias("rev"))
    return (t.sellers.select("seller_id", "seller_state").join(by_seller, "seller_id")
            .groupBy("seller_state").agg(round_money(F.sum("rev")).alias("total_price"))
            .orderBy(desc("total_price"), asc("seller_state")))


def top_categories_per_state(t: Tables, k: int = 3) -> DataFrame:
    """The ``k`` translated categories with most revenue in each
    customer state (ties broken by name)."""
    per = t.items.groupBy("order_id", "product_id").agg(F.sum("price").alias("rev"))
    by_product = (per.join(_order_places(t), "order_id")
                  .groupBy("customer_state", "product_id").agg(F.sum("rev").alias("rev")))
    look = category_lookup(t, translated="inner")
    by_cat = (by_product.join(look, "product_id").groupBy("customer_state", EN)
              .agg(F.sum("rev").alias("rev")))
    ranked = top_k_per_group(by_cat, ["customer_state"], [desc("rev"), asc(EN)], k)
    return (ranked.select("customer_state", EN, round_money(F.col("rev")).alias("total_price"))
            .orderBy(asc("customer_state"), desc("total_price"), asc(EN)))


def seller_customer_flows(t: Tables) -> DataFrame:
    """Item rows between each seller place and customer place, labelled
    same / different state and city."""
    per = t.items.groupBy("order_id", "seller_id").agg(one().alias("n"))
    by_seller = (per.join(_order_places(t), "order_id")
                 .groupBy("seller_id", "customer_state", "customer_city")
                 .agg(F.sum("n").alias("n")))
    flows = (t.sellers.select("seller_id", "seller_state", "seller_city").join(by_seller, "seller_id")
             .groupBy("seller_state", "customer_state", "seller_city", "customer_city")
             .agg(F.sum("n").alias("total_orders")))
    return flows.select(
        "seller_state", "customer_state", "seller_city", "customer_city", "total_orders",
        F.when(F.col("seller_state") == F.col("customer_state"), SAME_STATE)
        .otherwise(OTHER_STATE).alias("state_match_status"),
        F.when(F.col("seller_city") == F.col("customer_city"), SAME_CITY)
        .otherwise(OTHER_CITY).alias("city_match_status"))


def flow_match_totals(t: Tables) -> DataFrame:
    """Item rows per (state label, city label); the totals add up to
    all item rows that reach a seller and a customer."""
    return (seller_customer_flows(t).groupBy("state_match_status", "city_match_status")
            .agg(F.sum("total_orders").alias("total_orders")))


def state_cancellation_rate(t: Tables, min_orders: int = 50) -> DataFrame:
    """Canceled share of orders per customer state (``min_orders`` up)."""
    j = t.orders.select("customer_id", "order_id", "order_status").join(
        t.customers.select("customer_id", "customer_state"), "customer_id")
    canceled = F.when(F.col("order_status") == CANCELED, 1).otherwise(0)
    return (j.groupBy("customer_state")
            .agg(F.count("order_id").alias("total_orders_from_state"),
                 F.sum(canceled).alias("total_canceled_orders"))
            .filter(F.col("total_orders_from_state") >= min_orders)
            .withColumn("cancellation_rate_percent",
                        rate_percent(F.col("total_canceled_orders"),
                                     F.col("total_orders_from_state")))
            .orderBy(desc("cancellation_rate_percent"), desc("total_orders_from_state"),
                     asc("customer_state")))


def revenue_by_customer_state(items_s: DataFrame, orders_s: DataFrame, t: Tables) -> DataFrame:
    """Delivered silver revenue per customer state."""
    per = items_s.groupBy("order_id").agg(F.sum("price").alias("rev"))
    places = _order_places(t, delivered_orders(orders_s))
    return (per.join(places, "order_id").groupBy("customer_state")
            .agg(round_money(F.sum("rev")).alias("total_price"))
            .orderBy(desc("total_price"), asc("customer_state")))


def top_category_per_city(items_s: DataFrame, orders_s: DataFrame, t: Tables) -> DataFrame:
    """The translated category with most delivered silver revenue in
    each customer city; equal rounded revenues all stay (rank = 1)."""
    per = items_s.groupBy("order_id", "product_id").agg(F.sum("price").alias("rev"))
    places = _order_places(t, delivered_orders(orders_s))
    by_product = (per.join(places, "order_id")
                  .groupBy("customer_city", "product_id").agg(F.sum("rev").alias("rev")))
    by_cat = (by_product.join(category_lookup(t, translated="inner"), "product_id")
              .groupBy("customer_city", EN)
              .agg(round_money(F.sum("rev")).alias("total_price")))
    best = top_k_per_group(by_cat, ["customer_city"], [desc("total_price")], 1, ties=True)
    return (best.select("customer_city", F.col(EN).alias("most_category"), "total_price")
            .orderBy(desc("total_price"), asc("customer_city"), asc("most_category")))


def _translated(t: Tables, by_product: DataFrame) -> DataFrame:
    """Rows already aggregated by product, kept if their category is translated."""
    return by_product.join(category_lookup(t, translated="inner").select("product_id", EN),
                           "product_id")


def state_service_profile(t: Tables) -> DataFrame:
    """Per customer state over delivered, priced, translated items ⋈
    reviews (each item once per review row): revenue, mean freight/price,
    mean score, mean days to answer a review."""
    return _service_measures(t).orderBy(desc("total_price"), asc("customer_state"))


def _service_measures(t: Tables) -> DataFrame:
    ratio = ratio_units(F.col("freight_value"), F.col("price"))
    by_product = t.items.filter(F.col("price") > 0).groupBy("order_id", "product_id").agg(
        one().alias("n_i"), F.sum("price").alias("price_sum"),
        F.sum(ratio).alias("ratio_sum"), F.count(ratio).alias("ratio_n"))
    itm = _translated(t, by_product).groupBy("order_id").agg(
        *(F.sum(c).alias(c) for c in ("n_i", "price_sum", "ratio_sum", "ratio_n")))
    days = elapsed_days("review_creation_date", "review_answer_timestamp")
    rv = t.reviews.groupBy("order_id").agg(
        one().alias("n_r"), F.sum("review_score").alias("score_sum"),
        F.count("review_score").alias("score_n"), F.sum(days).alias("ans_sum"),
        F.count(days).alias("ans_n"))
    places = _order_places(t, delivered_orders(t.orders))
    j = itm.join(rv, "order_id").join(places, "order_id")
    n_i, n_r = F.col("n_i"), F.col("n_r")
    return (j.groupBy("customer_state").agg(
        as_double(F.sum(F.col("price_sum") * n_r)).alias("total_price"),
        units_mean(F.sum(F.col("ratio_sum") * n_r), F.sum(F.col("ratio_n") * n_r))
        .alias("avg_cargo_ratio"),
        (F.sum(n_i * F.col("score_sum")) / F.sum(n_i * F.col("score_n"))).alias("avg_score"),
        (F.sum(n_i * F.col("ans_sum")) / F.sum(n_i * F.col("ans_n"))).alias("avg_answer_time_day")))


#: Keys of an order on one side above which the order is paired by several tasks.
HOT_ORDER_ROWS = 10_000


def hot_orders(left: DataFrame, right: DataFrame, hot: int, pieces: int) -> DataFrame:
    """(order_id, left_pieces, right_pieces): orders with more than ``hot`` rows on a
    side, and in how many pieces each side is cut (``hot`` rows a piece, ``pieces`` at most).
    Orders are few beside rows, and hot ones few beside orders."""
    rows = (left.groupBy("order_id").agg(one().alias("nl"))
            .join(right.groupBy("order_id").agg(one().alias("nr")), "order_id")
            .where((F.col("nl") > hot) | (F.col("nr") > hot)))
    cut = lambda n: F.least(F.ceil(F.col(n) / hot), F.lit(pieces)).cast("int")
    return rows.select("order_id", cut("nl").alias("left_pieces"), cut("nr").alias("right_pieces"))


def _paired(left: DataFrame, right: DataFrame, pieces: int,
            hot: int = HOT_ORDER_ROWS) -> DataFrame:
    """Every (left, right) row pair of an order.  Ordinary orders are sent once.  An
    order with more than ``hot`` rows on a side is cut into a grid sized by its
    rows: each left row has one piece and is sent to a whole row of the grid, each right
    row to a column, so it is paired in many tasks.  The pairs are what the report groups by."""
    heavy = hot_orders(left, right, hot, pieces)
    piece = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    along = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = [F.coalesce(F.col(n), F.lit(1)).alias(n) for n in ("left_pieces", "right_pieces")]

    def sized(df: DataFrame) -> DataFrame:
        return df.join(heavy, "order_id", "left").select(*df.columns, *sizes)

    a, b = sized(left), sized(right)
    drop = ("left_pieces", "right_pieces")
    a = a.withColumn("_p", piece(left, "left_pieces")).withColumn("_q", along("right_pieces")).drop(*drop)
    b = b.withColumn("_q", piece(right, "right_pieces")).withColumn("_p", along("left_pieces")).drop(*drop)
    return a.join(b, ["order_id", "_p", "_q"]).drop("_p", "_q")


def state_profile_top_categories(t: Tables, level: str = "group", pieces: int = 64,
                                 hot: int = HOT_ORDER_ROWS) -> DataFrame:
    """H26's measures taken over distinct (state, category, price,
    freight, score, review times) groups, plus per state the category of
    the group with most revenue and of the group with most rows.

    As written, a group's revenue and row count count item x review pairs;
    the pairs of distinct keys are what the statement groups by, so they are
    formed, those of orders with more than ``hot`` keys on a side in a grid of at
    most ``pieces`` x ``pieces`` tasks; rows behind a key are only counted.  The two "rank = 1" self-joins become one
    min_by per state (ties go to the smaller name).

    ``level="category"`` is the reading the titles suggest: H26's row-level
    measures, and the categories with most revenue and most item x review
    rows per state.
    """
    if level == "category":
        return _state_profile_by_category(t)
    item_keys = _translated(t, t.items.filter(F.col("price") > 0)
                            .groupBy("order_id", "product_id", "price", "freight_value")
                            .agg(one().alias("n_i")))
    ik = item_keys.groupBy("order_id", EN, "price", "freight_value").agg(F.sum("n_i").alias("n_i"))
    rk = t.reviews.groupBy("order_id", "review_score", "review_answer_timestamp",
                           "review_creation_date").agg(one().alias("n_r"))
    places = _order_places(t, delivered_orders(t.orders)).select("order_id", "customer_state")
    w = F.col("n_i") * F.col("n_r")
    groups = (_paired(ik.join(places, "order_id"), rk, pieces, hot)
              .groupBy("customer_state", EN, "price", "freight_value", "review_score",
                       "review_answer_timestamp", "review_creation_date")
              .agg(F.sum(F.col("price") * w).alias("category_monetary"),
                   F.sum(w).alias("category_count")))
    days = elapsed_days("review_creation_date", "review_answer_timestamp")
    ratio = ratio_units(F.col("freight_value"), F.col("price"))
    return (groups.groupBy("customer_state").agg(
        as_double(F.sum("price")).alias("total_price"),
        units_mean(F.sum(ratio), F.count(ratio)).alias("avg_cargo_ratio"),
        F.avg("review_score").alias("avg_score"),
        F.avg(days).alias("avg_answer_time_day"),
        F.min_by(EN, F.struct(-F.col("category_monetary"), F.col(EN)))
        .alias("most_monetary_category"),
        F.min_by(EN, F.struct(-F.col("category_count"), F.col(EN)))
        .alias("most_counted_category"))
        .orderBy(desc("total_price"), asc("customer_state")))


def _state_profile_by_category(t: Tables) -> DataFrame:
    per = _translated(t, t.items.filter(F.col("price") > 0).groupBy("order_id", "product_id")
                      .agg(one().alias("n_i"), F.sum("price").alias("price_sum")))
    per = per.groupBy("order_id", EN).agg(F.sum("n_i").alias("n_i"),
                                          F.sum("price_sum").alias("price_sum"))
    rv = t.reviews.groupBy("order_id").agg(one().alias("n_r"))
    places = _order_places(t, delivered_orders(t.orders)).select("order_id", "customer_state")
    cats = (per.join(rv, "order_id").join(places, "order_id")
            .groupBy("customer_state", EN)
            .agg(F.sum(F.col("price_sum") * F.col("n_r")).alias("m"),
                 F.sum(F.col("n_i") * F.col("n_r")).alias("c")))
    tops = cats.groupBy("customer_state").agg(
        F.min_by(EN, F.struct(-F.col("m"), F.col(EN))).alias("most_monetary_category"),
        F.min_by(EN, F.struct(-F.col("c"), F.col(EN))).alias("most_counted_category"))
    return (_service_measures(t).join(tops, "customer_state")
            .orderBy(desc("total_price"), asc("customer_state")))
