"""Sales and revenue: status mix, best sellers, payment mix, AOV, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions import (as_double, asc, desc, exact_mean, rank_in_groups, round_money,
                               sentinel, top_k, week_label, year_month)
from mercato.operators._shared import (EN, delivered_orders, one, pair_factor, per_order,
                                       review_stats, with_category)
from mercato.sources import Tables


def order_status_counts(t: Tables) -> DataFrame:
    """Orders per non-null status, most frequent first."""
    return (t.orders.filter(F.col("order_status").isNotNull())
            .groupBy("order_status")
            .agg(F.count("order_status").alias("tekrar_sayisi"))
            .orderBy(desc("tekrar_sayisi"), asc("order_status")))


def top_products_delivered(t: Tables, k: int = 10) -> DataFrame:
    """Products with most item rows in delivered orders.

    Orders ⟕ items ⟕ products ⟕ translation, grouped by product; delivered
    orders without items form a null product with count 0.
    """
    def rows(t: Tables) -> DataFrame:
        d = delivered_orders(t.orders).select("order_id")
        per = t.items.groupBy("order_id", "product_id").agg(F.count("product_id").alias("n"))
        return d.join(per, "order_id", "left")

    by_product = (per_order(t, rows).groupBy("product_id")
                  .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_order_count")))
    out = with_category(by_product, t, translated="left", products="left").select(
        "product_id", EN, "total_order_count")
    return top_k(out, k, [desc("total_order_count"), asc("product_id"), asc(EN)])


def payment_type_totals(t: Tables) -> DataFrame:
    """Payment value per payment type."""
    return (t.payments.groupBy("payment_type")
            .agg(round_money(F.sum("payment_value")).alias("total_payment"))
            .orderBy(desc("total_payment"), asc("payment_type")))


def apportioned_payments(t: Tables) -> DataFrame:
    """(order_id, English category, value): each order's payments split over its
    categories by their share of the order's price, in whole cents.

    Every category gets its share rounded down; the cents left over go one each to the
    largest remainders, ties by name (null first).  An order without items, or without
    any price, gives all to the first category by name (null without items).
    Shares add up to the payments to the cent.
    """
    cents = lambda c: (F.col(c) * 100).cast("decimal(30,0)")
    pay = t.payments.groupBy("order_id").agg(F.round(F.sum("payment_value"), 2).alias("paid"))
    pay = pay.where("paid IS NOT NULL").select("order_id", cents("paid").alias("paid"))
    by_product = t.items.groupBy("order_id", "product_id").agg(F.sum("price").alias("price"))
    named = (with_category(by_product, t, translated="left", products="left")
             .groupBy("order_id", EN).agg(F.sum("price").alias("price"))
             .select("order_id", EN, F.coalesce(cents("price"), F.lit(0).cast("decimal(30,0)")).alias("price")))
    # an order's categories are at most all categories
    order = Window.partitionBy("order_id")
    j = pay.join(named, "order_id", "left").withColumn("all", F.sum("price").over(order))
    j = j.withColumn("price", F.coalesce("price", F.lit(0))).withColumn("all", F.coalesce("all", F.lit(0)))
    j = j.withColumn("share", F.when(F.col("all") > 0, F.expr("(paid * price) DIV all")).otherwise(0))
    j = j.withColumn("rest", F.when(F.col("all") > 0, F.expr("(paid * price) % all")).otherwise(0))
    left = F.col("paid") - F.sum("share").over(order)
    turn = F.row_number().over(order.orderBy(F.desc("rest"), F.asc_nulls_first(EN)))
    extra = (F.when(F.col("all") > 0, F.when(turn <= left, 1).otherwise(0))
             .otherwise(F.when(turn == 1, F.col("paid")).otherwise(0)))
    return j.select("order_id", EN, ((F.col("share") + extra) / 100).cast("decimal(30,2)").alias("value"))


def category_payment_vs_price(t: Tables, k: int | None = 10, payments: str = "per_row") -> DataFrame:
    """Payments ⟕ items ⟕ products ⟕ translation by English category.

    ``payments="per_order"`` counts each payment once: it is split over the order's
    categories (:func:`apportioned_payments`), and prices are those of the paid orders' items.

    As written, every payment row of an order meets every item row, so both
    sums count each other's rows; that product is computed per order from
    pre-aggregated counts instead of being materialised.
    """
    if payments == "per_order":
        return _payments_per_order(t, k)

    def rows(t: Tables) -> DataFrame:
        pay = t.payments.groupBy("order_id").agg(F.sum("payment_value").alias("pay_sum"),
                                                 one().alias("pay_rows"))
        itm = t.items.groupBy("order_id", "product_id").agg(F.sum("price").alias("price_sum"),
                                                            one().alias("item_rows"))
        return pay.join(itm, "order_id", "left")

    by_product = per_order(t, rows).groupBy("product_id").agg(
        F.sum(F.col("pay_sum") * F.coalesce(F.col("item_rows"), F.lit(1))).alias("v"),
        F.sum(F.col("price_sum") * F.col("pay_rows")).alias("p"))
    out = (with_category(by_product, t, translated="left", products="left")
           .groupBy(EN)
           .agg(round_money(F.sum("v")).alias("total_value"),
                round_money(F.sum("p")).alias("total_price")))
    return top_k(out, k, [desc("total_value"), asc(EN)])


def _payments_per_order(t: Tables, k: int | None) -> DataFrame:
    paid = t.payments.where("payment_value IS NOT NULL").select("order_id").distinct()
    by_product = (t.items.groupBy("order_id", "product_id").agg(F.sum("price").alias("price"))
                  .join(paid, "order_id", "left_semi").groupBy("product_id").agg(F.sum("price").alias("p")))
    prices = (with_category(by_product, t, translated="left", products="left")
              .groupBy(EN).agg(round_money(F.sum("p")).alias("total_price")))
    values = apportioned_payments(t).groupBy(EN).agg(round_money(F.sum("value")).alias("total_value"))
    out = (values.join(prices.withColumnRenamed(EN, "_en"), F.col(EN).eqNullSafe(F.col("_en")), "left")
           .select(EN, "total_value", "total_price"))
    order = [desc("total_value"), asc(EN)]
    return top_k(out, k, order) if k else out.orderBy(*order)


def _aov_columns(total: str = "_rev", n: str = "_n") -> list:
    return [round_money(F.col(total)).alias("total_revenue"),
            F.round(F.col(n).cast("double"), 2).alias("total_orders"),
            round_money(exact_mean(F.col(total), F.col(n))).alias("average_order_value")]


def aov_all_time(items_s: DataFrame) -> DataFrame:
    """Revenue, orders and average order value of the silver items."""
    return (items_s.agg(F.sum("price").alias("_rev"), F.count_distinct("order_id").alias("_n"))
            .select(*_aov_columns()))


def _approved_months(orders_s: DataFrame) -> DataFrame:
    ts = F.col("order_approved_at")
    dtype = orders_s.schema["order_approved_at"].dataType
    return (orders_s.filter(ts != sentinel(dtype))
            .select("order_id", F.year(ts).alias("sale_year"), F.month(ts).alias("sale_month")))


def aov_monthly(items_s: DataFrame, orders_s: DataFrame) -> DataFrame:
    """Monthly revenue, orders and AOV by approval month (sentinel out)."""
    j = items_s.select("order_id", "price").join(_approved_months(orders_s), "order_id")
    return (j.groupBy("sale_year", "sale_month")
            .agg(F.sum("price").alias("_rev"), F.count_distinct("order_id").alias("_n"))
            .select("sale_year", "sale_month", *_aov_columns())
            .orderBy("sale_year", "sale_month"))


def _category_totals(items_s: DataFrame, t: Tables) -> DataFrame:
    by_product = items_s.groupBy("product_id").agg(
        F.count("product_id").alias("n"), F.sum("price").alias("rev"))
    return with_category(by_product, t, translated="inner").groupBy(EN).agg(
        F.sum("n").alias("n"), F.sum("rev").alias("rev"))


def category_item_counts(items_s: DataFrame, t: Tables) -> DataFrame:
    """Silver item rows per translated category."""
    return (_category_totals(items_s, t)
            .select(F.col(EN).alias("product_category"), F.col("n").alias("product_count"))
            .orderBy(desc("product_count"), asc("product_category")))


def category_revenue(items_s: DataFrame, t: Tables) -> DataFrame:
    """Silver revenue per translated category."""
    return (_category_totals(items_s, t)
            .select(F.col(EN).alias("product_category"),
                    round_money(F.col("rev")).alias("total_revenue"))
            .orderBy(desc("total_revenue"), asc("product_category")))


def _approved_orders(orders_s: DataFrame) -> DataFrame:
    ts = F.col("order_approved_at")
    dtype = orders_s.schema["order_approved_at"].dataType
    return orders_s.filter(ts.isNotNull() & (ts != sentinel(dtype)))


def orders_per_month(orders_s: DataFrame) -> DataFrame:
    """Distinct approved orders per ``YYYY-MM``."""
    return (_approved_orders(orders_s)
            .groupBy(year_month("order_approved_at").alias("year_month"))
            .agg(F.count_distinct("order_id").alias("total_orders"))
            .orderBy("year_month"))


def orders_per_week(orders_s: DataFrame) -> DataFrame:
    """Distinct approved orders per ``YYYY-WW`` (Monday weeks 00-53)."""
    return (_approved_orders(orders_s)
            .groupBy(week_label("order_approved_at").alias("year_week"))
            .agg(F.count_distinct("order_id").alias("total_orders"))
            .orderBy("year_week"))


def revenue_monthly(items_s: DataFrame, orders_s: DataFrame) -> DataFrame:
    """Silver revenue per approval month (sentinel out)."""
    j = items_s.select("order_id", "price").join(_approved_months(orders_s), "order_id")
    return (j.groupBy("sale_year", "sale_month")
            .agg(round_money(F.sum("price")).alias("total_revenue"))
            .orderBy("sale_year", "sale_month"))


def orders_revenue_monthly(t: Tables) -> DataFrame:
    """Item rows ("orders") and revenue per purchase month."""
    ts = F.col("order_purchase_timestamp")

    def rows(t: Tables) -> DataFrame:
        per = t.items.groupBy("order_id").agg(one().alias("n"), F.sum("price").alias("rev"))
        o = t.orders.select("order_id", F.year(ts).alias("year"), F.month(ts).alias("month"))
        return o.join(per, "order_id")

    return (per_order(t, rows)
            .groupBy("year", "month")
            .agg(F.sum("n").alias("total_orders"), as_double(F.sum("rev")).alias("total_revenue"))
            .orderBy("year", "month"))


def aov_raw_items(t: Tables) -> DataFrame:
    """Average order value over all item rows."""
    return (t.items.agg(F.sum("price").alias("_rev"), F.count_distinct("order_id").alias("_n"))
            .select(round_money(exact_mean(F.col("_rev"), F.col("_n"))).alias("AOV")))


def category_leaders(t: Tables, min_items: int = 500, min_reviews: int = 50,
                     k: int = 20) -> DataFrame:
    """Large categories with revenue, volume, mean score and a
    satisfaction rank (by rounded score, then review count).

    Items ⋈ products ⟕ translation ⟕ reviews, as written: each item counts
    once per review row of its order.  The orders join of the source adds
    nothing (left join on its key) and is left out.
    """
    def rows(t: Tables) -> DataFrame:
        itm = t.items.groupBy("order_id", "product_id").agg(
            one().alias("item_rows"), F.count("order_item_id").alias("item_ids"),
            F.sum("price").alias("price_sum"))
        return itm.join(review_stats(t.reviews), "order_id", "left")

    mult = pair_factor()
    by_product = per_order(t, rows).groupBy("product_id").agg(
        F.sum(F.col("item_ids") * mult).alias("items"),
        F.sum(F.col("price_sum") * mult).alias("rev"),
        F.sum(F.col("item_rows") * F.coalesce("rv_scores", F.lit(0))).alias("scores"),
        F.sum(F.col("item_rows") * F.col("rv_score_sum")).alias("score_sum"))
    metrics = (with_category(by_product, t, translated="left").groupBy(EN)
               .agg(F.sum("items").alias("total_items_sold"),
                    round_money(F.sum("rev")).alias("total_revenue"),
                    F.round(F.try_divide(F.sum("score_sum").cast("double"), F.sum("scores")), 2)
                    .alias("average_review_score"),
                    F.sum("scores").alias("total_reviews_count"))
               .filter((F.col("total_items_sold") >= min_items)
                       & (F.col("total_reviews_count") >= min_reviews)))
    # a score of two decimals has at most 401 values
    ranked = rank_in_groups(metrics, "average_review_score", ["total_reviews_count"],
                            "satisfaction_rank").select(
        EN, "total_revenue", "total_items_sold", "average_review_score",
        F.col("satisfaction_rank").cast("int").alias("satisfaction_rank"))
    return top_k(ranked, k, [desc("total_revenue"), asc(EN)])


def product_performance(t: Tables, k: int = 100) -> DataFrame:
    """Delivered, priced items per product with orders, revenue and
    review figures (each item counts once per review row of its order)."""
    def rows(t: Tables) -> DataFrame:
        d = delivered_orders(t.orders).select("order_id")
        itm = (t.items.filter(F.col("price") > 0).groupBy("order_id", "product_id")
               .agg(one().alias("item_rows"), F.sum("price").alias("price_sum")))
        return itm.join(d, "order_id", "left_semi").join(review_stats(t.reviews), "order_id", "left")

    n = F.col("item_rows")
    by_product = per_order(t, rows).groupBy("product_id").agg(
        one().alias("total_sales_count"),
        F.sum(F.col("price_sum") * pair_factor()).alias("rev"),
        F.sum(n * F.col("rv_score_sum")).alias("score_sum"),
        F.sum(n * F.col("rv_scores")).alias("scores"),
        F.coalesce(F.sum(n * F.col("rv_ids")), F.lit(0)).alias("total_review_count"))
    out = with_category(by_product, t, translated="inner").select(
        EN, "product_id", "total_sales_count",
        as_double(F.col("rev")).alias("total_monetary"),
        F.try_divide(F.col("score_sum").cast("double"), F.col("scores")).alias("average_review_score"),
        "total_review_count")
    return top_k(out, k, [desc("total_sales_count"), desc("total_monetary"),
                          desc("average_review_score"), asc("product_id")])
