"""Tiny hand-made source tables (FIXTURES.md section 4) with the export's
schemas: string keys, zone-aware timestamps, DECIMAL(18,2) money."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from mercato.sources import Tables
from mercato.sources.schema import SOURCE_SCHEMAS
from pyspark.sql import types as T

COLUMNS = {
    "customers": ["customer_id", "customer_unique_id", "customer_city", "customer_state"],
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
               "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date"],
    "items": ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date",
              "price", "freight_value"],
    "payments": ["order_id", "payment_type", "payment_value"],
    "reviews": ["review_id", "order_id", "review_score", "review_creation_date",
                "review_answer_timestamp"],
    "products": ["product_id", "product_category_name"],
    "translation": ["product_category_name", "product_category_name_english"],
    "sellers": ["seller_id", "seller_city", "seller_state"],
}


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def m(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def _schema(name: str) -> T.StructType:
    full = {f.name: f for f in SOURCE_SCHEMAS[name].fields}
    return T.StructType([full[c] for c in COLUMNS[name]])


def make_tables(spark: SparkSession, **rows) -> Tables:
    """Build a Tables bundle; tables not given are empty."""
    frames = {}
    for name in COLUMNS:
        data = rows.get(name, [])
        frames[name] = spark.createDataFrame(data, _schema(name))
    return Tables(**frames)


def order(oid, cid=None, status="delivered", purchase="2018-01-01 10:00:00", approved=None,
          carrier=None, delivered=None):
    return (oid, cid or f"c{oid}", status, ts(purchase), ts(approved) if approved else None,
            ts(carrier) if carrier else None, ts(delivered) if delivered else None)


def item(oid, n, pid="p1", sid="s1", price=10, freight=1, limit="2018-01-05 00:00:00"):
    return (oid, n, pid, sid, ts(limit), m(price), m(freight))


def review(rid, oid, score=5, created="2018-01-10 00:00:00", answered="2018-01-11 00:00:00"):
    return (rid, oid, score, ts(created), ts(answered))
