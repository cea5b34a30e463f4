"""Figures over all rows that no single task makes: ranks and distinct counts."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mercato.functions import asc, desc, rank_in_groups, rank_ranged
from mercato.operators import sellers
from mercato.plans.inspect import explain_text, unpartitioned_windows
from tests.fixtures import item, make_tables, order


def _plain(df, order):
    by = [desc(c) if down else asc(c) for c, down in order]
    return df.withColumn("r", F.rank().over(Window.orderBy(*by)).cast("long"))


@pytest.mark.parametrize("pieces", [1, 3, 16])
@pytest.mark.parametrize("distinct", [1, 2, 7, 500, 5000])
def test_rank_with_ties_across_pieces(spark, pieces, distinct):
    df = spark.range(5000).select(
        "id", (F.xxhash64("id") % distinct).cast("double").alias("a"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 2).alias("b"))
    order = [("a", True), ("b", False)]
    got = rank_ranged(df, order, "r", pieces)
    assert unpartitioned_windows(got) == []
    assert sorted(got.select("id", "r").collect()) == sorted(_plain(df, order).select("id", "r").collect())


def test_a_value_that_holds_most_rows_is_spread(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3900, 5).otherwise(F.col("id")).alias("a"))
    got = rank_ranged(df.repartition(4), [("a", False)], "r", 8).collect()
    assert {r.r for r in got if r.a == 5} == {1}
    assert sorted(r.r for r in got if r.a != 5) == list(range(3901, 4001))


def test_rank_of_odd_rows(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (None,), (1.0,), (1.0,), (float("inf"),)], "a double")
    for down in (True, False):
        got = rank_ranged(df, [("a", down)], "r", 4)
        assert sorted(map(str, got.collect())) == sorted(map(str, _plain(df, [("a", down)]).collect()))
    assert rank_ranged(df.where("a = 7"), [("a", True)], "r", 4).count() == 0


def test_rank_in_groups(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 13 != 0, F.xxhash64("id") % 7 / 4).alias("a"),
        F.when(F.col("id") % 11 != 0, F.xxhash64("id", F.lit(1)) % 5).alias("b"))
    got = rank_in_groups(df, "a", ["b"], "r")
    assert unpartitioned_windows(got) == []
    assert sorted(got.select("id", "r").collect()) == sorted(
        _plain(df, [("a", True), ("b", True)]).select("id", "r").collect())
    assert rank_in_groups(df.where("a = 77"), "a", ["b"], "r").count() == 0


def test_months_merge_into_quarters(spark):
    t = make_tables(
        spark, orders=[order("o1", approved="2018-01-02 00:00:00"), order("o2", approved="2018-02-02 00:00:00"),
                       order("o3", approved="2018-04-01 00:00:00"), order("o4", approved=None),
                       order("o5", approved="2018-03-05 00:00:00", status="canceled")],
        items=[item("o1", 1, sid="s1"), item("o1", 2, sid="s1"), item("o1", 3, sid="s2"),
               item("o2", 1, sid="s1"), item("o2", 2, sid=None), item("o3", 1, sid=None),
               item("o4", 1, sid="s9"), item("o5", 1, sid="s8")])
    months = sellers.seller_months(t).cache()
    assert [tuple(r) for r in sellers.activity_by_month(months).collect()] == [
        (2018, 1, 2, 3), (2018, 2, 1, 2), (2018, 4, 0, 1)]
    assert sellers.activity_by_month(months).collect() == sellers.seller_activity_monthly(t).collect()
    assert [tuple(r) for r in sellers.activity_by_quarter(months).collect()] == [
        (2018, 1, 2, 5), (2018, 2, 0, 1)]
    assert sellers.activity_by_quarter(sellers.seller_months(make_tables(spark))).count() == 0


def test_more_sellers_than_a_bitmap_holds(spark):
    n = 70_000
    t = make_tables(spark, orders=[order("o1", approved="2018-01-02 00:00:00"),
                                   order("o2", approved="2018-03-02 00:00:00")])
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "o1").otherwise("o2").alias("order_id"),
                                 F.concat(F.lit("s"), F.col("id") % (n // 2)).alias("seller_id"))
    t = t.with_(items=rows)
    months = sellers.seller_months(t)
    assert {r.bucket for r in months.select("bucket").distinct().collect()} == {1, 2}
    assert sellers.activity_by_month(months).collect() == sellers.seller_activity_monthly(t).collect()
    assert [tuple(r) for r in sellers.activity_by_quarter(months).collect()] == [(2018, 1, n // 2, n)]


def test_registered_activity_reads_the_stored_bitmaps(spark, sf_dir):
    import __spark_entry__ as entry
    for name in ("seller_activity_monthly", "seller_activity_quarterly"):
        text = explain_text(entry.queries()[name](spark, sf_dir))
        assert "bitmap_or_agg" in text and "seller_id" not in text.lower()
