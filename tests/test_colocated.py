"""Facts co-located on the order, with hot orders in side tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from mercato.operators import delivery, geography, sales, sellers
from mercato.plans.inspect import explain_text
from mercato.sources import LazyTables, staging, stand_in_tables
from mercato.sources.staging import stage_colocated
from tests.fixtures import item, make_tables, order, review

REPORTS = {
    "H02": sales.top_products_delivered, "H04": sales.category_payment_vs_price,
    "H22": sales.category_leaders, "H25": sales.product_performance,
    "I13": sales.orders_revenue_monthly, "H07": sellers.seller_activity_monthly,
    "H08": sellers.category_volume_monthly, "H15": sellers.seller_cancellations,
    "H19": sellers.seller_cancellation_rate, "H09": geography.revenue_by_seller_state,
    "H21": delivery.score_vs_delays,
}
HOT = 60  # rows that make an order hot in these tests


@pytest.fixture(scope="module")
def plain(spark, sf_dir):
    t = stand_in_tables(spark, sf_dir)
    # an order with many item rows, and item rows without an order
    big = t.items.where("order_id % 500 = 0").withColumn("order_id", F.lit(77).cast("long"))
    lost = t.items.where("order_id % 900 = 1").withColumn("order_id", F.lit(None).cast("long"))
    return t.with_(items=t.items.unionByName(big).unionByName(lost))


@pytest.fixture(scope="module")
def colocated(spark, plain):
    return stage_colocated(spark, plain, uuid.uuid4().hex, buckets=4, hot_rows=HOT)


def test_sides_share_no_order_and_lose_no_row(plain, colocated):
    bucketed, hot = colocated.parts
    assert {r.order_id for r in hot.items.select("order_id").distinct().collect()} == {77, None}
    assert [r.order_id for r in hot.orders.collect()] == [77]
    assert bucketed.items.where("order_id IS NULL OR order_id = 77").isEmpty()
    for name in ("orders", "items", "payments", "reviews"):
        a, b = getattr(plain, name), getattr(colocated, name)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_agree(plain, colocated, name):
    assert REPORTS[name](colocated).collect() == REPORTS[name](plain).collect()


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_bucketed_side_is_not_shuffled_by_order(spark, colocated, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        alone = REPORTS[name](colocated.parts[0])
        assert "hashpartitioning(order_id" not in explain_text(alone, "simple")
        # the whole report shuffles by order on its hot side only
        assert "hashpartitioning(order_id" in explain_text(REPORTS[name](colocated), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_order_is_read_by_several_tasks(spark):
    rows = [item("big", n, pid=f"p{n % 5}") for n in range(400)] + [item("o1", 1)]
    t = make_tables(spark, orders=[order("big"), order("o1")], items=rows, reviews=[review("r", "big")])
    t = t.with_(items=t.items.repartition(8))
    co = stage_colocated(spark, t, uuid.uuid4().hex, buckets=2, hot_rows=HOT)
    hot = co.parts[1].items
    assert hot.count() == 400
    assert hot.select(F.spark_partition_id()).distinct().count() > 1
    assert co.parts[0].items.count() == 1


def test_a_second_session_reads_the_stored_state(spark):
    t = make_tables(spark, orders=[order("a")], items=[item("a", 1)])
    state = uuid.uuid4().hex
    first = stage_colocated(spark, t, state, buckets=2, hot_rows=HOT)
    assert first.items.count() == 1
    staging._READ_BACK.clear()
    other = spark.newSession()
    changed = make_tables(other, orders=[order("a")], items=[item("a", 1), item("a", 2)])
    again = stage_colocated(other, changed, state, buckets=2, hot_rows=HOT)
    assert again.items.count() == 1  # the state names what is stored


def test_a_copy_with_other_tables_has_no_parts(spark):
    t = make_tables(spark, orders=[order("a")], items=[item("a", 1, price=3)])
    co = stage_colocated(spark, t, uuid.uuid4().hex, buckets=2, hot_rows=HOT)
    two = make_tables(spark, items=[item("a", 1, price=3), item("a", 2, price=4)]).items
    copy = co.with_(items=two)
    assert isinstance(copy, LazyTables) and getattr(copy, "parts", None) is None
    assert sales.orders_revenue_monthly(copy).first().total_revenue == 7.0
    assert sales.orders_revenue_monthly(co).first().total_revenue == 3.0


def test_empty_tables(spark):
    co = stage_colocated(spark, make_tables(spark), uuid.uuid4().hex, buckets=2, hot_rows=HOT)
    assert sales.orders_revenue_monthly(co).count() == 0
    assert co.items.count() == 0
