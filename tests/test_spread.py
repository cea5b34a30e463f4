"""Steps per key in as many tasks as the rows need, against the session's shuffle partitions."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import spread, spread_plan, spreading
from mercato.functions.spreading import large_keys
from mercato.operators import rfm, sellers
from mercato.plans.inspect import explain_text
from tests.fixtures import item, make_tables, order


@pytest.fixture
def small_tasks(monkeypatch):
    """Tasks of 20 rows, and keys above 40 rows kept apart."""
    monkeypatch.setattr(spreading, "TASK_ROWS", 20)
    monkeypatch.setattr(spreading, "HOT_KEY_ROWS", 40)


@pytest.fixture
def shop(spark):
    """600 items: one order and one seller hold many of them, some have no seller, product or
    order; one customer has many orders, some orders have none."""
    orders = [order(f"o{i}", f"c{i if i % 3 else 0}", "canceled" if i % 10 == 9 else "delivered",
                    f"2018-{i % 12 + 1:02d}-03 10:00:00", f"2018-{i % 12 + 1:02d}-05 00:00:00")
              for i in range(200)]
    orders += [("o200", None, "delivered", orders[0][3], orders[0][4], None, None), orders[5]]
    rows = [item("o1" if i % 4 == 0 else f"o{i % 201}", i, None if i % 17 == 0 else f"p{i % 23 if i % 2 else 0}",
                 None if i % 13 == 0 else f"s{i % 19 if i % 3 else 0}", 10 + i) for i in range(600)]
    rows += [item(None, 1), item("o7", 900, sid=None, pid=None)]
    products = [(f"p{i}", f"k{i % 5}" if i % 6 else None) for i in range(20)]
    return make_tables(spark, orders=orders, items=rows, products=products,
                       translation=[(f"k{i}", f"en{i}") for i in range(4)],
                       sellers=[(f"s{i}", "x", f"z{i % 3}") for i in range(15)])


QUERIES = {
    "seller_months": lambda t: sellers.activity_by_quarter(sellers.seller_months(t)),
    "seller_activity_monthly": sellers.seller_activity_monthly,
    "seller_category_mix": lambda t: sellers.seller_category_mix(t, 10_000),
    "category_volume_monthly": sellers.category_volume_monthly,
    "seller_cancellation_rate": lambda t: sellers.seller_cancellation_rate(t, 1, 10_000),
    "rfm_metrics": lambda t: rfm.rfm_metrics(t, "2019-01-01"),
    "rfm_scores": lambda t: rfm.rfm_scores(t, "2019-01-01"),
}


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_in_more_tasks(spark, shop, name, monkeypatch):
    plain = QUERIES[name](shop)
    assert "REPARTITION_BY_NUM" not in explain_text(plain)
    expected = _rows(plain)
    monkeypatch.setattr(spreading, "TASK_ROWS", 20)
    monkeypatch.setattr(spreading, "HOT_KEY_ROWS", 40)
    assert expected and _rows(QUERIES[name](shop)) == expected


def test_tasks_grow_with_the_rows(spark, shop, small_tasks):
    # before: every shuffle had the session's number of partitions, whatever the rows
    for df in (sellers.seller_months(shop), sellers.category_volume_monthly(shop),
               rfm.rfm_metrics(shop, "2019-01-01"), sellers.seller_category_mix(shop)):
        assert ", 31), REPARTITION_BY_NUM" in explain_text(df, "simple")


def test_ordinary_keys_need_one_shuffle(spark, small_tasks):
    df = spark.range(600).select((F.col("id") % 150).alias("k"), "id")
    plan = spread_plan([df], "k")
    assert (plan.tasks, plan.hot, plan.nulls) == (30, None, False)
    (part,) = spread(df, "k", plan)
    assert part.rdd.getNumPartitions() == 30
    counted = part.groupBy("k").agg(F.count("id").alias("n"))
    assert explain_text(counted, "simple").count("Exchange") == 1
    assert sorted(map(tuple, counted.collect())) == [(k, 4) for k in range(150)]


def test_hot_keys_and_rows_without_a_key_are_kept_apart(spark, small_tasks):
    df = spark.range(600).select(
        F.when(F.col("id") % 4 == 0, F.lit(-1)).when(F.col("id") % 7 != 0, F.col("id")).alias("k"), "id")
    rest, apart = spread(df, "k", spread_plan([df], "k"))
    assert {r.k for r in apart.select("k").distinct().collect()} == {-1, None}
    assert rest.where("k = -1 OR k IS NULL").count() == 0
    assert sorted(r.id for r in reduce(DataFrame.union, [rest, apart]).collect()) == list(range(600))
    assert spread_plan([df], "k", task_rows=10**6) is None and spread(df, "k", None) == [df]


@pytest.mark.parametrize("bins", [1, 2, 65_536])
def test_large_keys_are_found_whatever_their_bins(spark, bins, monkeypatch):
    monkeypatch.setattr(spreading, "BINS", bins)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 4)
                                  .when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    exact = {r.k for r in df.where("k IS NOT NULL").groupBy("k").count().where("count > 200").collect()}
    assert exact and {r.k for r in large_keys(df, "k", 200).collect()} == exact
    assert large_keys(df, "k", 3000).count() == 0
