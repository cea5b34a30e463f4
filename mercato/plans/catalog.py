"""Named reports: every analytic statement as a function of a Tables bundle.

``REPORTS[name](tables, spark)`` returns the lazy DataFrame.  Parameters
that the source takes from the clock (``CURRENT_DATE``) are fixed dates here
so results are reproducible; callers pass their own through the operator
functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators import (customers, delivery, geography, quality, rfm, risk, sales,
                               sellers)
from mercato.sources import Tables

RFM_AS_OF = "2001-12-31"
DELAYED_AS_OF = "2001-08-10"

Report = Callable[[Tables, SparkSession], DataFrame]


# Reports read the stored silver, score and bitmap tables where the bundle has them
# (see mercato.plans.materialize.with_derived), else the lazy forms.

def _is(t: Tables) -> DataFrame:
    return t.items_silver if "items_silver" in t.names() else quality.items_silver(t.items)


def _os(t: Tables) -> DataFrame:
    return t.orders_silver if "orders_silver" in t.names() else quality.orders_silver(t.orders)


def _rs(t: Tables) -> DataFrame:
    return t.reviews_silver if "reviews_silver" in t.names() else quality.reviews_silver(t.reviews)


def _scores(t: Tables) -> DataFrame:
    return t.scores if "scores" in t.names() else rfm.rfm_scores(t, as_of=RFM_AS_OF)


def _sm(t: Tables) -> DataFrame:
    return t.seller_months if "seller_months" in t.names() else sellers.seller_months(t)


def _with_repeats(t: Tables) -> DataFrame:
    """Orders with every tenth one twice and every thirtieth three times."""
    o, k = t.orders, F.col("order_id")
    return o.unionAll(o.filter(k % 10 == 0)).unionAll(o.filter(k % 30 == 0))


REPORTS: dict[str, Report] = {
    # S1 scans
    "scan_customers": lambda t, s: t.customers,
    "scan_orders": lambda t, s: t.orders,
    "scan_items": lambda t, s: t.items,
    "scan_payments": lambda t, s: t.payments,
    "scan_reviews": lambda t, s: t.reviews,
    "scan_products": lambda t, s: t.products,
    "scan_translation": lambda t, s: t.translation,
    "scan_sellers": lambda t, s: t.sellers,
    # D01-D18 data quality
    "items_key_count": lambda t, s: quality.items_key_count(t),
    "items_silver": lambda t, s: quality.items_silver(t.items),
    "items_silver_stored": lambda t, s: _is(t),
    "items_negative_price": lambda t, s: quality.items_negative_price(_is(t)),
    # the same statement with a bound that fits the stand-in prices
    "items_low_price": lambda t, s: quality.items_negative_price(_is(t), below=2000),
    "items_null_rows": lambda t, s: quality.null_rows(_is(t), ("price", "seller_id")),
    "items_null_profile": lambda t, s: quality.items_null_profile(_is(t)),
    "items_silver_pk_audit": lambda t, s: quality.items_silver_pk_audit(_is(t)),
    "items_istanbul_date": lambda t, s: quality.items_local_date(_is(t)),
    "orders_duplicate_rows": lambda t, s: quality.orders_duplicate_rows(t.orders),
    "orders_duplicate_rows_repeated": lambda t, s: quality.orders_duplicate_rows(_with_repeats(t)),
    "orders_pk_audit": lambda t, s: quality.orders_pk_audit(t),
    "orders_null_status": lambda t, s: quality.orders_null_status(t),
    "orders_null_delivery": lambda t, s: quality.orders_null_status(
        t, column="order_delivered_customer_date"),
    "orders_null_approved": lambda t, s: quality.orders_null_approved(t),
    "orders_silver": lambda t, s: quality.orders_silver(t.orders),
    "orders_silver_stored": lambda t, s: _os(t),
    "orders_approved_label": lambda t, s: quality.orders_approved_label(t),
    "reviews_key_count": lambda t, s: quality.reviews_key_count(t),
    "reviews_duplicate_profile": lambda t, s: quality.reviews_duplicate_profile(t),
    "reviews_silver": lambda t, s: quality.reviews_silver(t.reviews),
    "reviews_silver_stored": lambda t, s: _rs(t),
    "reviews_null_rows": lambda t, s: quality.null_rows(
        _rs(t), ("order_id", "review_score", "review_creation_date", "review_answer_timestamp")),
    "reviews_null_profile": lambda t, s: quality.reviews_null_profile(_rs(t)),
    "reviews_silver_pk_audit": lambda t, s: quality.reviews_silver_pk_audit(_rs(t)),
    "customers_pk_audit": lambda t, s: quality.customers_pk_audit(t),
    "raw_orders_repeat_check": lambda t, s: quality.raw_orders_repeat_check(t),
    # sales and revenue
    "order_status_counts": lambda t, s: sales.order_status_counts(t),
    "top_products_delivered": lambda t, s: sales.top_products_delivered(t),
    "payment_type_totals": lambda t, s: sales.payment_type_totals(t),
    "category_payment_vs_price": lambda t, s: sales.category_payment_vs_price(t),
    "category_payment_per_order": lambda t, s: sales.category_payment_vs_price(
        t, k=None, payments="per_order"),
    "aov_all_time": lambda t, s: sales.aov_all_time(_is(t)),
    "aov_monthly": lambda t, s: sales.aov_monthly(_is(t), _os(t)),
    "category_item_counts": lambda t, s: sales.category_item_counts(_is(t), t),
    "category_revenue": lambda t, s: sales.category_revenue(_is(t), t),
    "orders_per_month": lambda t, s: sales.orders_per_month(_os(t)),
    "orders_per_week": lambda t, s: sales.orders_per_week(_os(t)),
    "revenue_monthly": lambda t, s: sales.revenue_monthly(_is(t), _os(t)),
    "orders_revenue_monthly": lambda t, s: sales.orders_revenue_monthly(t),
    "aov_raw_items": lambda t, s: sales.aov_raw_items(t),
    "category_leaders": lambda t, s: sales.category_leaders(t),
    "product_performance": lambda t, s: sales.product_performance(t),
    # sellers
    "active_sellers": lambda t, s: sellers.active_sellers(t),
    "seller_category_mix": lambda t, s: sellers.seller_category_mix(t),
    "seller_activity_monthly": lambda t, s: sellers.activity_by_month(_sm(t)),
    "seller_activity_quarterly": lambda t, s: sellers.activity_by_quarter(_sm(t)),
    "category_volume_monthly": lambda t, s: sellers.category_volume_monthly(t),
    "seller_cancellations": lambda t, s: sellers.seller_cancellations(t),
    "seller_cancellation_rate": lambda t, s: sellers.seller_cancellation_rate(t),
    # geography
    "revenue_by_seller_state": lambda t, s: geography.revenue_by_seller_state(t),
    "top_categories_per_state": lambda t, s: geography.top_categories_per_state(t),
    "seller_customer_flows": lambda t, s: geography.seller_customer_flows(t),
    "flow_match_totals": lambda t, s: geography.flow_match_totals(t),
    "state_cancellation_rate": lambda t, s: geography.state_cancellation_rate(t),
    "revenue_by_customer_state": lambda t, s: geography.revenue_by_customer_state(_is(t), _os(t), t),
    "top_category_per_city": lambda t, s: geography.top_category_per_city(_is(t), _os(t), t),
    "state_service_profile": lambda t, s: geography.state_service_profile(t),
    "state_profile_top_categories": lambda t, s: geography.state_profile_top_categories(t),
    # risk
    "price_outliers": lambda t, s: risk.price_outliers(t),
    "freight_outliers": lambda t, s: risk.freight_outliers(t),
    "slowest_deliveries": lambda t, s: risk.slowest_deliveries(t),
    "approval_latency": lambda t, s: risk.approval_latency(t),
    "low_price_repeat_buyers": lambda t, s: risk.low_price_repeat_buyers(t),
    # same statement with a price bound that fits the stand-in prices (900+)
    "low_price_repeat_buyers_wide": lambda t, s: risk.low_price_repeat_buyers(
        t, max_avg_price=45000),
    "order_value_outliers": lambda t, s: risk.order_value_outliers(t),
    # customers
    "customer_lifetime_value": lambda t, s: customers.customer_lifetime_value(_is(t), _os(t)),
    "most_valuable_customers": lambda t, s: customers.most_valuable_customers(t),
    "repeat_purchase_gap": lambda t, s: customers.repeat_purchase_gap(t),
    "new_customers_monthly": lambda t, s: customers.new_customers_monthly(t),
    "average_clv": lambda t, s: customers.average_clv(t),
    # delivery and satisfaction
    "score_vs_delays": lambda t, s: delivery.score_vs_delays(t),
    "delivery_days_by_state": lambda t, s: delivery.delivery_days_by_state(_is(t), _os(t), t),
    "delivery_days_by_category": lambda t, s: delivery.delivery_days_by_category(_is(t), _os(t), t),
    "average_delivery_days": lambda t, s: delivery.average_delivery_days(t),
    "delayed_orders": lambda t, s: delivery.delayed_orders(t, as_of=DELAYED_AS_OF),
    "delayed_orders_sql": lambda t, s: delivery.delayed_orders_sql(s, t, DELAYED_AS_OF),
    "reviews_by_status": lambda t, s: delivery.reviews_by_status(t),
    "overall_review_score": lambda t, s: delivery.overall_review_score(t),
    "category_satisfaction": lambda t, s: delivery.category_satisfaction(t),
    # RFM
    "rfm_scores": lambda t, s: rfm.rfm_scores(t, as_of=RFM_AS_OF).select(
        "customer_id", "recency", "frequency", "monetary", "r_score", "f_score", "m_score"),
    "rfm_segments": lambda t, s: rfm.rfm_scores(t, as_of=RFM_AS_OF),
    "rfm_scores_stored": lambda t, s: _scores(t),
    "best_customer_payments": lambda t, s: rfm.best_customer_payments(_scores(t), t),
}
