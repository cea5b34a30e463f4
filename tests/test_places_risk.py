"""Hand fixtures for sellers, geography and risk operators."""

from mercato.operators import geography, quality, risk, sellers
from tests.fixtures import item, make_tables, order, review


def _geo(spark, orders, items, **extra):
    return make_tables(
        spark, orders=orders, items=items,
        customers=[(f"c{i}", f"u{i % 2}", "X_C0" if i % 2 else "Y_C0", "X" if i % 2 else "Y")
                   for i in range(1, 9)],
        sellers=[("s1", "X_C0", "X"), ("s2", "Y_C1", "Y")],
        products=[("p1", "cat_a"), ("p2", "cat_b"), ("p3", "cat_c")],
        translation=[("cat_a", "A"), ("cat_b", "B"), ("cat_c", "C")], **extra)


def test_tied_revenue_row_number_vs_rank(spark):
    t = _geo(spark, orders=[order("o1", "c1"), order("o2", "c1"), order("o3", "c1")],
             items=[item("o1", 1, pid="p2", price=10), item("o2", 1, pid="p1", price=10),
                    item("o3", 1, pid="p3", price=3)])
    h10 = [(r.customer_state, r.product_category_name_english)
           for r in geography.top_categories_per_state(t, k=1).collect()]
    assert h10 == [("X", "A")]  # one kept, smaller name wins the tie
    k13 = geography.top_category_per_city(quality.items_silver(t.items),
                                          quality.orders_silver(t.orders), t).collect()
    assert sorted(r.most_category for r in k13) == ["A", "B"]  # rank = 1 keeps both


def test_flows_conserve_item_rows(spark):
    t = _geo(spark, orders=[order(f"o{i}", f"c{i}") for i in range(1, 7)],
             items=[item(f"o{i}", j, sid=f"s{1 + (i + j) % 2}") for i in range(1, 7)
                    for j in range(1, 1 + i % 3 + 1)])
    flows = geography.seller_customer_flows(t)
    total = flows.groupBy().sum("total_orders").first()[0]
    assert total == t.items.count()
    by_label = geography.flow_match_totals(t).groupBy().sum("total_orders").first()[0]
    assert by_label == total
    same = flows.filter("state_match_status = 'Ayni Eyalet Icinde'").collect()
    assert all(r.seller_state == r.customer_state for r in same)


def test_rate_thresholds(spark):
    orders = [order(f"o{i}", "c1", status="canceled" if i < 3 else "delivered")
              for i in range(10)]
    items9 = [item(f"o{i}", 1, sid="s1") for i in range(9)]
    t = _geo(spark, orders=orders, items=items9 + [item("o9", 1, sid="s2")])
    assert sellers.seller_cancellation_rate(t).count() == 0  # s1 has 9 rows
    t2 = _geo(spark, orders=orders, items=items9 + [item("o9", 1, sid="s1")])
    r = sellers.seller_cancellation_rate(t2).first()
    assert (r.total_orders_handled, r.total_canceled_orders, r.cancellation_rate_percent) == (
        10, 3, 30.0)
    many = [order(f"o{i}", f"c{1 + i % 8}") for i in range(100)]
    t3 = _geo(spark, orders=many[:98], items=[])
    assert geography.state_cancellation_rate(t3).count() == 0  # 49 orders in each state
    t4 = _geo(spark, orders=many, items=[])
    assert geography.state_cancellation_rate(t4).count() == 2  # 50 in each


def test_price_and_order_outliers(spark):
    t = _geo(spark, orders=[order("o1", "c1"), order("o2", "c2")],
             items=[item("o1", 1, price=1, freight=1), item("o2", 1, price=3, freight=2),
                    item("o2", 2, price=4, freight=3)])
    top = risk.price_outliers(t).first()
    assert (top.order_id, float(top.price), top.price_vs_avg_ratio) == ("o2", 4.0, 1.5)
    fr = risk.freight_outliers(t).first()
    assert fr.freight_vs_avg_ratio == 1.5
    ov = risk.order_value_outliers(t).collect()
    assert [(r.order_id, r.total_order_price, r.overall_avg_order_price, r.price_vs_avg_ratio)
            for r in ov] == [("o2", 12.0, 7.0, 1.71), ("o1", 2.0, 7.0, 0.29)]


def test_zero_price_and_service_profile(spark):
    t = _geo(spark, orders=[order("o1", "c1")],
             items=[item("o1", 1, pid="p1", price=10, freight=1),
                    item("o1", 2, pid="p1", price=0, freight=1)],
             reviews=[review("r1", "o1", 4), review("r2", "o1", 2,
                                                    answered="2018-01-13 00:00:00")])
    r = geography.state_service_profile(t).first()
    assert (r.customer_state, r.total_price, r.avg_cargo_ratio, r.avg_score,
            r.avg_answer_time_day) == ("X", 20.0, 0.1, 3.0, 2.0)
    p = geography.state_profile_top_categories(t).first()
    assert (p.total_price, p.most_monetary_category, p.most_counted_category) == (20.0, "A", "A")


def test_low_price_repeat_buyers(spark):
    t = _geo(spark, orders=[order("o1", "c1"), order("o2", "c3"), order("o3", "c3",
                                                                        status="canceled")],
             items=[item("o1", 1, price=40), item("o2", 1, price=60), item("o3", 1, price=1)])
    r = risk.low_price_repeat_buyers(t).collect()
    assert [(x.customer_unique_id, x.total_orders, x.average_item_price,
             x.total_revenue_from_customer) for x in r] == [("u1", 2, 50.0, 100.0)]
    assert risk.low_price_repeat_buyers(t, max_avg_price=50).count() == 0


def test_active_sellers_and_mix(spark):
    t = _geo(spark, orders=[order("o1", "c1")],
             items=[item("o1", 1, pid="p1", sid="s1"), item("o1", 2, pid="p2", sid="s1"),
                    item("o1", 3, pid="p2", sid="zz")])
    assert sellers.active_sellers(t).first().counter_seller == 1
    mix = {(r.seller_id, r.product_category_name_english): r
           for r in sellers.seller_category_mix(t).collect()}
    assert set(mix) == {("s1", "A"), ("s1", "B")}
    assert mix[("s1", "A")].total_items_by_seller == 2
    assert mix[("s1", "A")].total_categories_by_seller == 2


def test_approval_latency_candidates(spark):
    t = _geo(spark, orders=[
        order("o1", "c1", purchase="2018-01-01 00:00:00", approved="2018-01-03 00:00:00"),
        order("o2", "c2", purchase="2018-01-01 00:00:00", approved="2018-01-02 00:00:00"),
        order("o3", "c3", purchase="2018-01-01 00:00:00", approved="2018-01-09 00:00:00"),
        order("o4", "c4", purchase="2018-01-01 00:00:00", approved=None)],
        items=[item("o1", 1, price=5), item("o1", 2, price=3), item("o1", 3, price=4),
               item("o2", 1, price=9), item("o4", 1, price=1)])
    # o3 is slowest but has no items; o1's three items fill k = 2
    got = [(r.order_id, float(r.price)) for r in risk.approval_latency(t, k=2).collect()]
    assert got == [("o1", 3.0), ("o1", 4.0)]
    got = [(r.order_id, r.approval_duration_seconds)
           for r in risk.approval_latency(t, k=4).collect()]
    assert got == [("o1", 172800)] * 3 + [("o2", 86400)]
    fast = [r.order_id for r in risk.approval_latency(t, k=1, fastest_first=True).collect()]
    assert fast == ["o2"]


def test_state_profile_category_level(spark):
    # A: one expensive item; B: three cheap items -> A leads revenue, B rows
    t = _geo(spark, orders=[order("o1", "c1"), order("o2", "c1")],
             items=[item("o1", 1, pid="p1", price=100, freight=10),
                    item("o2", 1, pid="p2", price=5, freight=1),
                    item("o2", 2, pid="p2", price=6, freight=1),
                    item("o2", 3, pid="p2", price=7, freight=1)],
             reviews=[review("r1", "o1", 5), review("r2", "o2", 3)])
    by_cat = geography.state_profile_top_categories(t, level="category").first()
    assert (by_cat.most_monetary_category, by_cat.most_counted_category) == ("A", "B")
    h26 = geography.state_service_profile(t).first()
    assert (by_cat.total_price, by_cat.avg_score) == (h26.total_price, h26.avg_score) == (
        118.0, 3.5)


def test_approval_latency_without_a_customer_row(spark):
    """A slow order without a customer takes no candidate's place; ties at k go by id."""
    slow = [("o1", "gone", "2018-01-09 10:00:00"), ("o2", "c1", "2018-01-05 10:00:00"),
            ("o3", "c3", "2018-01-05 10:00:00"), ("o4", "c1", "2018-01-02 10:00:00")]
    t = _geo(spark, orders=[order(o, c, approved=a) for o, c, a in slow],
             items=[item(o, 1, price=5) for o, _, _ in slow])
    assert [r.order_id for r in risk.approval_latency(t, k=2).collect()] == ["o2", "o3"]
    assert [r.order_id for r in risk.approval_latency(t, k=2, fastest_first=True).collect()] == [
        "o4", "o2"]
    hot = _geo(spark, orders=[order("o1", "c1", approved="2018-01-03 10:00:00"),
                              order("o2", "c3", approved="2018-01-02 10:00:00")],
               items=[item("o1", n, price=n) for n in range(1, 200)] + [item("o2", 1)])
    assert [float(r.price) for r in risk.approval_latency(hot, k=3).collect()] == [1.0, 2.0, 3.0]
    plan = risk.approval_latency(hot, k=3)._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(customer_id" in line and "price" in line
                   for line in plan.splitlines())


def test_a_large_order_is_paired_in_many_tasks(spark):
    t = _geo(spark, orders=[order("o1", "c1")],
             items=[item("o1", n, pid="p1", price=n, freight=1) for n in range(1, 60)],
             reviews=[review(f"r{n}", "o1", 1 + n % 5, answered=f"2018-01-{10 + n % 15} 00:00:00")
                      for n in range(40)])
    one, grid = (geography.state_profile_top_categories(t, pieces=p).collect() for p in (1, 4))
    assert one == grid
    left = spark.range(1000).selectExpr("'o' AS order_id", "id AS a")
    right = spark.range(1000).selectExpr("'o' AS order_id", "id AS b")
    pairs = geography._paired(left, right, 4)
    assert pairs.count() == 1_000_000


def test_only_hot_orders_are_cut(spark):
    left = spark.range(1000).selectExpr("if(id < 900, 'hot', concat('o', id)) AS order_id", "id AS a")
    right = spark.range(500).selectExpr("if(id < 300, 'hot', concat('o', 500 + id)) AS order_id", "id AS b")
    plain = left.join(right, "order_id")
    heavy = {r.order_id: (r.left_pieces, r.right_pieces)
             for r in geography.hot_orders(left, right, 100, 64).collect()}
    assert heavy == {"hot": (9, 3)}
    pairs = geography._paired(left, right, 64, hot=100)
    assert pairs.count() == plain.count() > 270_000 and pairs.exceptAll(plain).isEmpty()
    capped = geography._paired(left, right, 2, hot=100)
    assert capped.count() == plain.count()
