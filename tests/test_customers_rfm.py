"""Hand fixtures for customers, delivery and RFM operators."""

import itertools

import pytest
from pyspark.sql import functions as F

from mercato.operators import customers, delivery, quality, rfm
from tests.fixtures import item, m, make_tables, order, review


def _people(n):
    return [(f"c{i}", f"u{i}", "X_C0", "X") for i in range(1, n + 1)]


def test_clv_zero_days_and_yearly_rate(spark):
    t = make_tables(spark, customers=[("c1", "u1", "X_C0", "X"), ("c2", "u1", "X_C0", "X"),
                                      ("c3", "u2", "X_C0", "X"), ("c4", "u2", "X_C0", "X"),
                                      ("c5", "u3", "X_C0", "X")],
                    orders=[order("o1", "c1", approved="2018-01-01 09:00:00"),
                            order("o2", "c2", approved="2018-01-01 18:00:00"),
                            order("o3", "c3", approved="2018-01-01 09:00:00"),
                            order("o4", "c4", approved="2019-01-01 09:00:00"),
                            order("o5", "c5", approved="2018-03-03 09:00:00")],
                    items=[item(f"o{i}", 1, price=100) for i in range(1, 6)])
    by = {r.customer_unique_id: r for r in customers.customer_lifetime_value(
        quality.items_silver(t.items), quality.orders_silver(t.orders), t,
        grain="customer_unique_id").collect()}
    assert (by["u3"].lt_days, by["u3"].clv_estimated_yearly_brut) == (0, 100.0)  # one purchase
    assert (by["u1"].lt_days, by["u1"].customer_total_orders,
            by["u1"].clv_estimated_yearly_brut) == (0, 2, 200.0)  # two on one day
    assert by["u2"].lt_days == 365
    assert by["u2"].clv_estimated_yearly_brut == round(200 / 365 * 365.25, 2)
    # at customer_id grain nobody repeats
    per_id = customers.customer_lifetime_value(quality.items_silver(t.items),
                                               quality.orders_silver(t.orders))
    assert per_id.filter("lt_days != 0").count() == 0


def test_repeat_gap_and_new_customers(spark):
    t = make_tables(spark, customers=[("c1", "u1", "X_C0", "X"), ("c2", "u1", "X_C0", "X"),
                                      ("c3", "u2", "X_C0", "X")],
                    orders=[order("o1", "c1", purchase="2018-01-01 10:00:00"),
                            order("o2", "c2", purchase="2018-01-11 09:00:00"),
                            order("o3", "c3", purchase="2018-02-01 00:00:00")])
    # 9 whole days (23 h short of 10): a span, first to last
    assert customers.repeat_purchase_gap(t).first().AVG_DAY_BETWEEN_ORDERS == 9.0
    got = {(r.year, r.month): r.new_customers for r in customers.new_customers_monthly(t).collect()}
    assert got == {(2018, 1): 1, (2018, 2): 1}


def test_most_valuable_and_average_clv(spark):
    t = make_tables(spark, customers=[("c1", "u1", "X_C0", "X"), ("c2", "u1", "X_C0", "X")],
                    orders=[order("o1", "c1"), order("o2", "c2", status="canceled")],
                    payments=[("o1", "boleto", m(10)), ("o1", "voucher", m(2.5)),
                              ("o2", "boleto", m(99))],
                    items=[item("o1", 1, price=10, freight=1), item("o2", 1, price=5, freight=0)])
    r = customers.most_valuable_customers(t).collect()
    assert [(x.customer_unique_id, x.Total_Payment, x.Order_Status) for x in r] == [
        ("u1", 12.5, "delivered")]
    assert customers.average_clv(t).first().CLV == 16.0


def test_delayed_orders(spark):
    t = make_tables(spark, orders=[
        order("d1", purchase="2018-01-01 10:00:00", delivered="2018-01-11 09:00:00"),  # 10 days
        order("s_old", status="shipped", purchase="2018-01-01 00:00:00"),
        order("s_new", status="shipped", purchase="2018-01-25 00:00:00"),
        order("c_old", status="canceled", purchase="2017-01-01 00:00:00")])
    got = delivery.delayed_orders(t, as_of="2018-01-31").collect()
    assert [(r.order_id, r.days_since_purchase, r.avg_delivery_days) for r in got] == [
        ("s_old", 30, 10.0)]
    sql = delivery.delayed_orders_sql(spark, t, "2018-01-31").collect()
    today = delivery.delayed_orders_sql(spark, t).collect()
    assert sorted(today) == sorted(delivery.delayed_orders(t).collect()) and today
    assert [(r.order_id, r.days_since_purchase) for r in sql] == [("s_old", 30)]


def test_reviews_by_status_and_satisfaction(spark):
    t = make_tables(spark, orders=[order("o1"), order("o2", status="shipped")],
                    reviews=[review("r1", "o1", 5), review("r2", "o1", 2)],
                    items=[item("o1", 1, pid="p1"), item("o1", 2, pid="p9")],
                    products=[("p1", "cat_a"), ("p9", None)])
    got = {r.order_status: (r.Review_COUNT, r.AVG_Review_Score)
           for r in delivery.reviews_by_status(t).collect()}
    assert got == {"delivered": (2, 4.0), "shipped": (0, None)}
    cats = {r.product_category_name: (r.avg_score, r.review_count)
            for r in delivery.category_satisfaction(t).collect()}
    assert cats == {"cat_a": (3.5, 2), None: (3.5, 2)}


def test_quintile_thresholds_small(spark):
    # five customers, spend 1..5: thresholds are the values themselves
    people = _people(5)
    orders = [order(f"o{i}", f"c{i}", purchase=f"2018-01-0{i} 00:00:00") for i in range(1, 6)]
    items = [item(f"o{i}", 1, price=i) for i in range(1, 6)]
    t = make_tables(spark, customers=people, orders=orders, items=items)
    s = {r.customer_id: r for r in rfm.rfm_scores(t, as_of="2018-01-10").collect()}
    # thresholds 1,2,3,4; ">=" puts the P20 value itself in score 2
    assert [s[f"c{i}"].m_score for i in range(1, 6)] == [2, 3, 4, 5, 5]
    assert [s[f"c{i}"].r_score for i in range(1, 6)] == [1, 2, 3, 4, 5]
    # every frequency equals 1: all thresholds 1, every f-score 5
    assert {r.f_score for r in s.values()} == {5}
    assert s["c5"].RFM_Score == "555" and s["c5"].RFM_segment == rfm.BEST


SEGMENT_CASES = [
    ((5, 5, 5), rfm.BEST), ((4, 4, 4), rfm.LOYAL), ((5, 4, 5), rfm.LOYAL),
    ((5, 2, 1), rfm.NEW), ((2, 5, 4), rfm.HIGH_VALUE_AT_RISK), ((1, 1, 2), rfm.LOST),
    ((3, 4, 1), rfm.POTENTIAL_LOYAL), ((3, 3, 5), rfm.POTENTIAL_LOYAL),
    ((2, 3, 3), rfm.NEEDS_ATTENTION), ((1, 5, 1), rfm.OTHER), ((4, 5, 1), rfm.OTHER),
]


def test_segment_rules_first_match_wins(spark):
    df = spark.createDataFrame([c for c, _ in SEGMENT_CASES], "r int, f int, m int")
    got = [r.s for r in df.select(rfm.segment(F.col("r"), F.col("f"), F.col("m")).alias("s"))
           .collect()]
    assert got == [label for _, label in SEGMENT_CASES]


def test_every_score_triple_gets_one_segment(spark):
    triples = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(triples, "r int, f int, m int")
    out = df.select(rfm.segment(F.col("r"), F.col("f"), F.col("m")).alias("s"))
    assert out.filter(F.col("s").isNull()).count() == 0
    assert out.select("s").distinct().count() == 8


def test_best_customer_payments(spark):
    people = _people(5)
    orders = [order(f"o{i}", f"c{i}", purchase=f"2018-01-0{i} 00:00:00") for i in range(1, 6)]
    items = [item(f"o{i}", 1, price=i) for i in range(1, 6)]
    t = make_tables(spark, customers=people, orders=orders, items=items,
                    payments=[("o5", "boleto", m(5)), ("o5", "voucher", m(1)),
                              ("o1", "boleto", m(1))])
    scores = rfm.rfm_scores(t, as_of="2018-01-10")
    got = rfm.best_customer_payments(scores, t).collect()
    assert sorted((r.customer_id, r.order_id, r.payment_type) for r in got) == [
        ("c5", "o5", "boleto"), ("c5", "o5", "voucher")]


def test_clv_is_ordered(spark):
    t = make_tables(spark, orders=[order(f"o{i}", f"c{i}", approved="2018-01-02 00:00:00")
                                   for i in range(5)],
                    items=[item(f"o{i}", 1, price=[3, 9, 9, 1, 5][i]) for i in range(5)])
    rows = customers.customer_lifetime_value(t.items, t.orders).collect()
    assert [r.customer_id for r in rows] == ["c1", "c2", "c4", "c0", "c3"]


def test_thresholds_are_exact_at_any_size(spark):
    """Above 100 000 rows, with repeated, skewed and negative values, against a sort."""
    n = 150_000
    df = spark.range(n).selectExpr("(id * 7919) % 150000 AS a", "id % 3 AS b",
                                   "exp(((id * 31) % 150000) / 9000.0) AS c", "-(id % 1000) AS d")
    cols = {c: F.col(c) for c in "abcd"}
    q = rfm.exact_thresholds(df, cols).first().q
    for c in "abcd":
        values = sorted(r[0] for r in df.select(F.col(c).cast("double")).collect())
        assert list(q[c]) == [values[-(-k * n // 5) - 1] for k in (1, 2, 3, 4)], c


def test_thresholds_with_hot_values(spark):
    """Values holding whole fifths, whose sketched bounds meet, between rare ones."""
    n = 60_000
    df = spark.range(n, numPartitions=7).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 5.0 WHEN id % 3 = 1 THEN id / 10000 ELSE 5.5 END AS a",
        "CASE WHEN id % 10 < 9 THEN 1 ELSE id END AS b")
    q = rfm.exact_thresholds(df, {c: F.col(c) for c in "ab"}).first().q
    for c in "ab":
        values = sorted(r[0] for r in df.select(F.col(c).cast("double")).collect())
        assert list(q[c]) == [values[-(-k * n // 5) - 1] for k in (1, 2, 3, 4)], c


def test_thresholds_of_few_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "a double")
    assert list(rfm.exact_thresholds(df, {"a": F.col("a")}).first().q["a"]) == [1.0, 1.0, 2.0, 2.0]


def test_sketch_is_an_option(spark):
    t = make_tables(spark, orders=[order(f"o{i}", f"c{i}") for i in range(20)],
                    items=[item(f"o{i}", 1, price=i + 1) for i in range(20)])
    exact, sketch = (rfm.rfm_scores(t, as_of="2018-02-01", thresholds=how).collect()
                     for how in ("exact", "sketch"))
    assert sorted(exact) == sorted(sketch)


def test_two_table_functions_keep_their_own_bundles(spark):
    def bundle(*ids):
        return make_tables(spark, orders=[
            order("done" + ids[0], "c0", purchase="2018-01-01 10:00:00", delivered="2018-01-03 10:00:00"),
            *[order(i, "c" + i, status="shipped", purchase="2018-01-05 10:00:00") for i in ids]])
    for name, ids in (("late_a", ("10", "11")), ("late_b", ("77",))):
        assert delivery.register_delayed_orders_function(spark, bundle(*ids), name) == name
    call = lambda name: sorted(r.order_id for r in spark.sql(
        f"SELECT * FROM {name}(DATE'2018-02-01')").collect())
    assert call("late_a") == ["10", "11"] and call("late_b") == ["77"]
    delivery.register_delayed_orders_function(spark, bundle("12"), "late_a")
    assert call("late_a") == ["12"] and call("late_b") == ["77"]
    spark.range(1).createOrReplaceTempView("late_c__orders")
    with pytest.raises(ValueError, match="late_c__orders"):
        delivery.register_delayed_orders_function(spark, bundle("1"), "late_c")
    assert spark.table("late_c__orders").columns == ["id"]
