"""Column contracts of the eight source tables, checked at load.

Keys may be strings (the original export) or integers (the stand-in tables);
money is DECIMAL(18,2); times are timestamps with or without time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = "key"
TEXT = "text"
TS = "timestamp"
MONEY = "money"
INT = "int"

_FAMILIES = {
    KEY: (T.StringType, T.LongType, T.IntegerType),
    TEXT: (T.StringType,),
    TS: (T.TimestampType, T.TimestampNTZType),
    MONEY: (T.DecimalType,),
    INT: (T.IntegerType, T.LongType, T.ShortType, T.ByteType),
}

CONTRACTS: dict[str, dict[str, str]] = {
    "customers": {"customer_id": KEY, "customer_unique_id": KEY,
                  "customer_city": TEXT, "customer_state": TEXT},
    "orders": {"order_id": KEY, "customer_id": KEY, "order_status": TEXT,
               "order_purchase_timestamp": TS, "order_approved_at": TS,
               "order_delivered_carrier_date": TS,
               "order_delivered_customer_date": TS},
    "items": {"order_id": KEY, "order_item_id": INT, "product_id": KEY,
              "seller_id": KEY, "shipping_limit_date": TS, "price": MONEY,
              "freight_value": MONEY},
    "payments": {"order_id": KEY, "payment_type": TEXT, "payment_value": MONEY},
    "reviews": {"review_id": KEY, "order_id": KEY, "review_score": INT,
                "review_creation_date": TS, "review_answer_timestamp": TS},
    "products": {"product_id": KEY, "product_category_name": TEXT},
    "translation": {"product_category_name": TEXT,
                    "product_category_name_english": TEXT},
    "sellers": {"seller_id": KEY, "seller_city": TEXT, "seller_state": TEXT},
}

# Spark types used when reading the original CSV/parquet export.
MONEY_TYPE = T.DecimalType(18, 2)

SOURCE_SCHEMAS: dict[str, T.StructType] = {
    "customers": T.StructType([
        T.StructField("customer_id", T.StringType()),
        T.StructField("customer_unique_id", T.StringType()),
        T.StructField("customer_zip_code_prefix", T.StringType()),
        T.StructField("customer_city", T.StringType()),
        T.StructField("customer_state", T.StringType()),
    ]),
    "orders": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_status", T.StringType()),
        T.StructField("order_purchase_timestamp", T.TimestampType()),
        T.StructField("order_approved_at", T.TimestampType()),
        T.StructField("order_delivered_carrier_date", T.TimestampType()),
        T.StructField("order_delivered_customer_date", T.TimestampType()),
        T.StructField("order_estimated_delivery_date", T.TimestampType()),
    ]),
    "items": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("order_item_id", T.IntegerType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("seller_id", T.StringType()),
        T.StructField("shipping_limit_date", T.TimestampType()),
        T.StructField("price", MONEY_TYPE),
        T.StructField("freight_value", MONEY_TYPE),
    ]),
    "payments": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("payment_sequential", T.IntegerType()),
        T.StructField("payment_type", T.StringType()),
        T.StructField("payment_installments", T.IntegerType()),
        T.StructField("payment_value", MONEY_TYPE),
    ]),
    "reviews": T.StructType([
        T.StructField("review_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("review_score", T.IntegerType()),
        T.StructField("review_comment_title", T.StringType()),
        T.StructField("review_comment_message", T.StringType()),
        T.StructField("review_creation_date", T.TimestampType()),
        T.StructField("review_answer_timestamp", T.TimestampType()),
    ]),
    "products": T.StructType([
        T.StructField("product_id", T.StringType()),
        T.StructField("product_category_name", T.StringType()),
    ]),
    "translation": T.StructType([
        T.StructField("product_category_name", T.StringType()),
        T.StructField("product_category_name_english", T.StringType()),
    ]),
    "sellers": T.StructType([
        T.StructField("seller_id", T.StringType()),
        T.StructField("seller_zip_code_prefix", T.StringType()),
        T.StructField("seller_city", T.StringType()),
        T.StructField("seller_state", T.StringType()),
    ]),
}


class ContractError(ValueError):
    pass


def check_contract(name: str, df: DataFrame) -> DataFrame:
    """Raise if ``df`` lacks a contract column or has one of the wrong kind.

    Only the schema is inspected (no Spark job runs).
    """
    by_name = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for col, kind in CONTRACTS[name].items():
        if col not in by_name:
            problems.append(f"missing column {col}")
        elif not isinstance(by_name[col], _FAMILIES[kind]):
            problems.append(f"{col}: {by_name[col].simpleString()} is not {kind}")
    if problems:
        raise ContractError(f"{name}: " + "; ".join(problems))
    return df
