"""Stand-in views of the eight source tables over the driver's test tables.

The test folders hold TPC-H-like tables (orders, lineitem, part, supplier,
customer, nation, events).  Each source table is derived from them by fixed
arithmetic (FIXTURES.md section 3).  Columns the test tables have nothing
like (status, approval and delivery times, review scores, payment types,
freight, categories, cities) are stand-ins derived from keys: they exercise
the computation and mean nothing as business figures.

Everything here is a lazy DataFrame; only the columns used are read, and the
only shuffle is the per-order numbering of items (``order_item_id``), which a
real export carries as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.ranking import row_number_split
from mercato.sources.schema import MONEY_TYPE, check_contract
from mercato.sources.tables import LazyTables

# Fixed values of the stand-in formulas (FIXTURES.md section 3).
PURCHASE_SECONDS_MULT, DAY_SECONDS = 7919, 86400
APPROVAL_NULL_EVERY, APPROVAL_MULT, APPROVAL_SPAN = 50, 104729, 172800
CARRIER_BASE, CARRIER_MULT, CARRIER_SPAN = 86400, 31, 259200
DELIVERY_BASE, DELIVERY_MULT, DELIVERY_SPAN = 345600, 15485863, 2592000
CATEGORY_NULL_EVERY, CATEGORY_SIZE_MOD = 60, 12
UNTRANSLATED = ("PROMO", 3)
CITY_MOD = 4
VOUCHER_EVERY, VOUCHER_VALUE = 10, "10.00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


def _city(state: Column, key: Column) -> Column:
    return F.concat(state, F.lit("_C"), (key % CITY_MOD).cast("string"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").alias("customer_id"),
            F.col("o_custkey").alias("customer_unique_id"),
            _city(F.col("n_name"), F.col("c_custkey")).alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pending, open_ = F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "O"
    status = (
        F.when(pending & (k % 5 == 0), "canceled")
        .when(pending & (k % 5 == 1), "unavailable")
        .when(open_ & (k % 4 == 0), "shipped")
        .otherwise("delivered")
    )
    purchase = _plus_seconds(F.col("o_orderdate"), k * PURCHASE_SECONDS_MULT % DAY_SECONDS)
    base = o.select(
        k.alias("order_id"), k.alias("customer_id"), status.alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
    )
    k, p = F.col("order_id"), F.col("order_purchase_timestamp")
    delivered = F.col("order_status") == "delivered"
    return base.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp",
        F.when(k % APPROVAL_NULL_EVERY == 0, F.lit(None))
        .otherwise(_plus_seconds(p, k * APPROVAL_MULT % APPROVAL_SPAN))
        .alias("order_approved_at"),
        F.when(delivered, _plus_seconds(p, CARRIER_BASE + k * CARRIER_MULT % CARRIER_SPAN))
        .alias("order_delivered_carrier_date"),
        F.when(delivered, _plus_seconds(p, DELIVERY_BASE + k * DELIVERY_MULT % DELIVERY_SPAN))
        .alias("order_delivered_customer_date"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    renamed = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        "l_linenumber", "l_extendedprice", "l_quantity", "l_tax",
    )
    # Numbered without putting a whole order in one task where it is large: a single
    # order may hold a large share of all item rows (runs jobs that count them).
    line_order = ["l_linenumber", "product_id", "seller_id", "l_extendedprice",
                  "shipping_limit_date", "l_quantity"]
    numbered = row_number_split(renamed, "order_id", line_order, "order_item_id")
    price = F.col("l_extendedprice").cast(MONEY_TYPE)
    return numbered.select(
        "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date",
        price.alias("price"),
        F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2).cast(MONEY_TYPE)
        .alias("freight_value"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = (F.when(F.col("o_orderpriority") == "1-URGENT", "boleto")
            .when(F.col("o_orderpriority") == "2-HIGH", "debit_card")
            .otherwise("credit_card"))
    first = F.struct(kind.alias("payment_type"),
                     F.col("o_totalprice").cast(MONEY_TYPE).alias("payment_value"))
    voucher = F.when(k % VOUCHER_EVERY == 0, F.struct(
        F.lit("voucher").alias("payment_type"),
        F.lit(VOUCHER_VALUE).cast(MONEY_TYPE).alias("payment_value")))
    # One scan of orders; the optional second payment row comes from explode.
    rows = F.filter(F.array(first, voucher), lambda r: r.isNotNull())
    return o.select(k.alias("order_id"), F.explode(rows).alias("p")).select(
        "order_id", "p.payment_type", "p.payment_value")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        eid.alias("review_id"),
        F.expr("(event_id * 9) div 10").alias("order_id"),
        (F.floor("value") % 5 + 1).cast("int").alias("review_score"),
        F.date_trunc("day", "ts").cast(e.schema["ts"].dataType).alias("review_creation_date"),
        _plus_seconds(F.col("ts"), (eid % 9) * DAY_SECONDS).alias("review_answer_timestamp"),
    )


def _category(p_type: Column, size: Column) -> Column:
    return F.concat(p_type, F.lit("_"), (size % CATEGORY_SIZE_MOD).cast("string"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % CATEGORY_NULL_EVERY == 0, F.lit(None).cast("string"))
        .otherwise(_category(F.col("p_type"), F.col("p_size")))
        .alias("product_category_name"),
    )


def translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    size = F.col("p_size") % CATEGORY_SIZE_MOD
    kept = ~((F.col("p_type") == UNTRANSLATED[0]) & (size == UNTRANSLATED[1]))
    return (
        p.filter(kept)
        .select(_category(F.col("p_type"), F.col("p_size")).alias("product_category_name"),
                _category(F.lower("p_type"), F.col("p_size")).alias("product_category_name_english"))
        .distinct()
    )


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("seller_id"),
        _city(F.col("n_name"), F.col("s_suppkey")).alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


#: The test tables the stand-ins are derived from.
INPUTS = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def stand_in_tables(spark: SparkSession, sf_dir: str) -> LazyTables:
    """All eight stand-in tables for one test folder, contracts checked; each is
    made when first used, so no job runs before that."""
    makers = {"customers": customers, "orders": orders, "items": items, "payments": payments,
              "reviews": reviews, "products": products, "translation": translation,
              "sellers": sellers}
    return LazyTables({name: lambda n=name, f=make: check_contract(n, f(spark, sf_dir))
                       for name, make in makers.items()})
