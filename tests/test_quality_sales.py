"""Hand fixtures for data quality and sales operators."""

import datetime as dt

from mercato.operators import quality, sales
from tests.fixtures import item, m, make_tables, order, review


def test_null_approval_sentinel_and_monthly(spark):
    t = make_tables(spark, orders=[
        order("o1", approved=None),
        order("o2", approved="2018-02-03 04:05:06"),
        order("o3", approved="1453-05-29 00:00:00"),
    ], items=[item("o1", 1, price=5), item("o2", 1, price=7), item("o3", 1, price=11)])
    os_ = quality.orders_silver(t.orders)
    got = {r.order_id: r.order_approved_at for r in os_.collect()}
    assert got["o1"] == dt.datetime(1453, 5, 29) and got["o3"] == dt.datetime(1453, 5, 29)
    assert got["o2"] == dt.datetime(2018, 2, 3, 4, 5, 6)
    # the sentinel (and a real 1453 value) leave every time series
    monthly = sales.aov_monthly(quality.items_silver(t.items), os_).collect()
    assert [(r.sale_year, r.sale_month, r.total_revenue) for r in monthly] == [(2018, 2, 7.0)]
    assert [r.year_month for r in sales.orders_per_month(os_).collect()] == ["2018-02"]
    labels = {r.order_id: r.order_approved_at for r in quality.orders_approved_label(t).collect()}
    assert labels["o1"] == "UNKNOWN" and labels["o2"] == "2018-02-03 04:05:06"
    assert quality.orders_null_approved(t).count() == 1


def test_dup_items_silver_keeps_first_item(spark):
    t = make_tables(spark, items=[item("a", 3, price=30), item("a", 1, price=10),
                                  item("a", 2, price=20), item("b", 1, price=5)])
    s = quality.items_silver(t.items)
    assert sorted((r.order_id, r.order_item_id) for r in s.collect()) == [("a", 1), ("b", 1)]
    audit = quality.items_silver_pk_audit(s).first()
    assert audit.is_key and audit.row_count == 2
    assert quality.items_key_count(t).first().asDict() == {"row_count": 4, "distinct_order_id": 2}
    k01 = sales.aov_all_time(s).first()
    assert (k01.total_revenue, k01.total_orders, k01.average_order_value) == (15.0, 2.0, 7.5)
    assert sales.aov_raw_items(t).first().AOV == 32.5  # 65 / 2 on raw items


def test_aov_rounds_half_up_on_exact_cents(spark):
    t = make_tables(spark, items=[item("a", 1, price="0.01"), item("b", 1, price="0.02")])
    # 0.03 / 2 = 0.015 exactly -> 0.02 (half up), not a binary-float 0.01
    assert sales.aov_raw_items(t).first().AOV == 0.02


def test_dup_reviews_profile_and_silver(spark):
    t = make_tables(spark, reviews=[
        review("r1", "o1"), review("r3", "o2"), review("r2", "o2"),
        review("r6", "o3"), review("r5", "o3"), review("r4", "o3")])
    prof = {r.reviews_per_order: r.order_count
            for r in quality.reviews_duplicate_profile(t).collect()}
    assert prof == {1: 1, 2: 1, 3: 1}
    s = {r.order_id: r.review_id for r in quality.reviews_silver(t.reviews).collect()}
    assert s == {"o1": "r1", "o2": "r2", "o3": "r4"}
    assert quality.reviews_key_count(t).first().asDict() == {"row_count": 6,
                                                             "distinct_order_id": 3}


def test_negative_and_null_price(spark):
    t = make_tables(spark, items=[item("a", 1, price=-1), item("b", 1, price=2)])
    assert quality.items_negative_price(t.items).count() == 1
    assert quality.items_null_profile(t.items).first().asDict() == {"null_price": 0,
                                                                    "null_seller_id": 0}


def _catalog(spark, **extra):
    base = dict(
        products=[("p1", "cat_a"), ("p2", "cat_b"), ("p3", None), ("p4", "cat_x")],
        translation=[("cat_a", "A"), ("cat_b", "B")],
    )
    base.update(extra)
    return make_tables(spark, **base)


def test_two_payments_times_two_items_fan_out(spark):
    t = _catalog(spark, orders=[order("o1")],
                 items=[item("o1", 1, pid="p1", price=10), item("o1", 2, pid="p1", price=20)],
                 payments=[("o1", "credit_card", m(25)), ("o1", "voucher", m(5))])
    got = sales.category_payment_vs_price(t).collect()
    # every payment meets every item: value 30 x 2 items, price 30 x 2 payments
    assert [(r.product_category_name_english, r.total_value, r.total_price) for r in got] == [
        ("A", 60.0, 60.0)]
    totals = {r.payment_type: r.total_payment for r in sales.payment_type_totals(t).collect()}
    assert totals == {"credit_card": 25.0, "voucher": 5.0}


def test_payment_without_items_forms_null_category(spark):
    t = _catalog(spark, payments=[("o9", "boleto", m(12))])
    got = sales.category_payment_vs_price(t).collect()
    assert [(r.product_category_name_english, r.total_value, r.total_price) for r in got] == [
        (None, 12.0, None)]


def test_no_items_order_and_untranslated(spark):
    t = _catalog(spark, orders=[order("o1"), order("o2"), order("o3", status="shipped")],
                 items=[item("o1", 1, pid="p1"), item("o1", 2, pid="p3"),
                        item("o1", 3, pid="p4"), item("o3", 1, pid="p2")])
    got = {(r.product_id, r.product_category_name_english): r.total_order_count
           for r in sales.top_products_delivered(t).collect()}
    # o2 has no items: null product with count 0; p3/p4 untranslated stay with null name
    assert got == {("p1", "A"): 1, ("p3", None): 1, ("p4", None): 1, (None, None): 0}
    # K04 joins translation inner: untranslated products drop out
    k04 = {r.product_category: r.product_count
           for r in sales.category_item_counts(quality.items_silver(t.items), t).collect()}
    assert k04 == {"A": 1, "B": 1}


def test_category_leaders_counts_item_review_pairs(spark):
    t = _catalog(spark, items=[item("o1", 1, pid="p1", price=10), item("o1", 2, pid="p1", price=10),
                               item("o2", 1, pid="p2", price=4)],
                 reviews=[review("r1", "o1", 5), review("r2", "o1", 4), review("r3", "o2", 2)])
    got = {r.product_category_name_english: r for r in
           sales.category_leaders(t, min_items=1, min_reviews=1).collect()}
    a = got["A"]
    assert (a.total_items_sold, a.total_revenue, a.average_review_score) == (4, 40.0, 4.5)
    assert got["A"].satisfaction_rank == 1 and got["B"].satisfaction_rank == 2
    assert sales.category_leaders(t, min_items=3, min_reviews=1).count() == 1


def test_product_performance_fan_out_and_zero_price(spark):
    t = _catalog(spark, orders=[order("o1"), order("o2")],
                 items=[item("o1", 1, pid="p1", price=10), item("o2", 1, pid="p1", price=0)],
                 reviews=[review("r1", "o1", 5), review("r2", "o1", 3)])
    r = sales.product_performance(t).first()
    assert (r.total_sales_count, r.total_monetary, r.average_review_score,
            r.total_review_count) == (1, 20.0, 4.0, 2)


def test_duplicate_order_rows(spark):
    t = make_tables(spark, orders=[order("o1"), order("o1"), order("o1", status="shipped"),
                                   order("o2")])
    got = sorted(r.order_status for r in quality.orders_duplicate_rows(t.orders).collect())
    assert got == ["delivered", "shipped"]  # three rows of o1, the first kept out
    assert not quality.orders_pk_audit(t).first().is_key


def test_items_option_raw_against_silver(spark):
    # K01 reads silver items by default; passing raw items gives I14's AOV
    t = make_tables(spark, items=[item("a", 1, price=10), item("a", 2, price=30),
                                  item("b", 1, price=5)])
    silver = sales.aov_all_time(quality.items_silver(t.items)).first()
    raw = sales.aov_all_time(t.items).first()
    assert (silver.total_revenue, silver.average_order_value) == (15.0, 7.5)
    assert (raw.total_revenue, raw.average_order_value) == (45.0, 22.5)
    assert raw.average_order_value == sales.aov_raw_items(t).first().AOV


def test_reviews_option_silver_removes_the_fan_out(spark):
    t = _catalog(spark, items=[item("o1", 1, pid="p1", price=10)],
                 reviews=[review("r1", "o1", 5), review("r2", "o1", 1)])
    as_written = sales.category_leaders(t, min_items=1, min_reviews=1).first()
    assert (as_written.total_items_sold, as_written.total_revenue) == (2, 20.0)
    one_review = t.with_(reviews=quality.reviews_silver(t.reviews))
    fixed = sales.category_leaders(one_review, min_items=1, min_reviews=1).first()
    assert (fixed.total_items_sold, fixed.total_revenue, fixed.average_review_score) == (
        1, 10.0, 5.0)


def test_payments_per_order_are_split_to_the_cent(spark):
    t = _catalog(spark,
                 items=[item("o1", 1, pid="p1", price=10), item("o1", 2, pid="p2", price=10),
                        item("o1", 3, pid="p4", price=10), item("o2", 1, pid="p1", price=0),
                        item("o2", 2, pid="p2", price=0), item("o3", 1, pid="p2", price=5)],
                 payments=[("o1", "credit_card", m("10.00")), ("o1", "voucher", m("0.01")),
                           ("o2", "boleto", m("3.33")), ("o9", "boleto", m("12"))])
    split = {(r.order_id, r.product_category_name_english): str(r.value)
             for r in sales.apportioned_payments(t).collect()}
    # 1001 cents in three equal parts: 333 each, the two left over to the first by name (null first)
    assert split == {("o1", None): "3.34", ("o1", "A"): "3.34", ("o1", "B"): "3.33",
                     ("o2", "A"): "3.33", ("o2", "B"): "0.00", ("o9", None): "12.00"}
    got = {r.product_category_name_english: (float(r.total_value), r.total_price and float(r.total_price))
           for r in sales.category_payment_vs_price(t, k=None, payments="per_order").collect()}
    assert got == {None: (15.34, 10.0), "A": (6.67, 10.0), "B": (3.33, 10.0)}
    assert round(sum(v for v, _ in got.values()), 2) == 25.34
    top = sales.category_payment_vs_price(t, k=1, payments="per_order").collect()
    assert [r.product_category_name_english for r in top] == [None]


def test_apportioned_payments_add_up(spark, sf_dir):
    from mercato.sources import stand_in_tables
    from pyspark.sql import functions as F
    t = stand_in_tables(spark, sf_dir)
    split = sales.apportioned_payments(t).groupBy("order_id").agg(F.sum("value").alias("v"))
    paid = t.payments.groupBy("order_id").agg(F.sum("payment_value").alias("p"))
    assert paid.join(split, "order_id", "full").where("p IS DISTINCT FROM v").isEmpty()
