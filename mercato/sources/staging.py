"""Store tables once and read them back.

The folder must be shared storage (the session's ``spark.checkpoint.dir``
by default): the stored tables cut the lineage back to the raw files, so a
lost executor re-reads stored files instead of recomputing the sources.

A table is stored when it is first used.  Its place is named by the state of
the input files and by the code that derives it, so a change of either is a
new table and never an old copy.

By default the tables are plain parquet.  With ``buckets=n`` the fact
tables (orders, items, payments, reviews) are bucketed on ``order_id`` and
customers on ``customer_id``: joins between facts and per-order aggregates
then need no shuffle.  The price is skew: a bucket is read by one task, so
an order holding a large share of all rows would be scanned by one task.
Unbucketed, that order is spread over many input splits and the partial
aggregates and partial group limits collapse it before any shuffle, which
is why bucketing is opt-in.

``stage_colocated`` has both: orders with many rows in a fact (and rows without an
order) go to plain side tables, all others to buckets.  The reports that
start from one order's facts (``operators._shared.per_order``) read the two apart.
"""

from __future__ import annotations

import hashlib
import inspect
import sys
import uuid
from collections.abc import Iterable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import ensure_checkpoint_dir
from mercato.sources.files import ConflictError, current_version, read_table, write_table
from mercato.sources.tables import LazyTables, Tables

# Read-back frames per (application, path): listing the files and reading
# the parquet footers happens once per session, not per report.
_READ_BACK: dict[tuple[str, str], DataFrame] = {}

BUCKET_KEYS = {"orders": "order_id", "items": "order_id", "payments": "order_id",
               "reviews": "order_id", "customers": "customer_id"}


def code_state(modules: Iterable[str]) -> str:
    """A hash of the source text of modules, wherever they are loaded from."""
    text = "".join(inspect.getsource(sys.modules[m]) for m in sorted(modules))
    return hashlib.sha1(text.encode()).hexdigest()


def stage_tables(spark: SparkSession, tables: Tables | LazyTables, state: str,
                 folder: str | None = None, buckets: int | None = None) -> LazyTables:
    """S3 + S4: a bundle that stores each table of ``tables`` when it is first
    used and reads it back.

    ``state`` stands for everything the tables depend on (see
    :func:`mercato.sources.files.input_state` and :func:`code_state`); a
    complete copy stored for the same state is reused.  Plain parquet folders
    need no catalog; bucketed tables are registered in the session catalog.
    """
    base = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/mercato-stage"
    tag = hashlib.sha1(f"{state}|{buckets or 0}".encode()).hexdigest()[:16]

    def stage(name: str) -> DataFrame:
        path, key = f"{base}/{tag}/{name}", BUCKET_KEYS.get(name)
        memo = (spark.sparkContext.applicationId, path)
        if memo not in _READ_BACK:
            if key and buckets:
                table = f"mercato_{tag}_{name}"
                if not spark.catalog.tableExists(table):
                    (getattr(tables, name).write.mode("overwrite").format("parquet")
                     .option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table))
                _READ_BACK[memo] = spark.table(table)
            else:
                if current_version(spark, path) is None:
                    _store_once(spark, getattr(tables, name), path)
                _READ_BACK[memo] = read_table(spark, path)
        return _READ_BACK[memo]

    return LazyTables({name: partial(stage, name) for name in tables.names()})


#: Facts that meet on ``order_id``, and the rows of an order above which it is hot.
ORDER_FACTS = ("orders", "items", "payments", "reviews")
HOT_ORDER_ROWS = 100_000


def _store_once(spark: SparkSession, df: DataFrame, path: str) -> None:
    if current_version(spark, path) is None:
        try:
            write_table(df, path, base=0)
        except ConflictError:
            pass  # another session stored the same state first


def _bucketed(spark: SparkSession, df: DataFrame, path: str, name: str, buckets: int,
              key: str) -> DataFrame:
    """``df`` in ``buckets`` files sorted by ``key``, and a table ``name`` over them.

    The files go to a folder of their own; which folder counts is stored as a
    table under ``path``, so of two sessions that store the same state one wins."""
    if current_version(spark, path) is None:
        own, place = f"{name}_{uuid.uuid4().hex}", f"{path}/data-{uuid.uuid4().hex}"
        (df.repartition(buckets, key).write.format("parquet").option("path", place)
         .bucketBy(buckets, key).sortBy(key).saveAsTable(own))
        spark.sql(f"DROP TABLE {own}")  # the files stay
        _store_once(spark, spark.createDataFrame([(place,)], "place string").coalesce(1), path)
    if not spark.catalog.tableExists(name):
        place = read_table(spark, path).first().place
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{place}' "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS")
    return spark.table(name)


def hot_keys(frames: Iterable[DataFrame], key: str, rows: int) -> DataFrame:
    """Values of ``key`` with more than ``rows`` rows in any of the frames: at most
    one for each ``rows`` rows of a frame."""
    heavy = [f.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > rows).select(key) for f in frames]
    return reduce(DataFrame.union, heavy).distinct()


def stage_colocated(spark: SparkSession, tables: Tables | LazyTables, state: str, buckets: int,
                    folder: str | None = None, hot_rows: int = HOT_ORDER_ROWS) -> LazyTables:
    """A bundle whose facts are stored co-located on ``order_id``, whatever its skew.

    Orders with more than ``hot_rows`` rows in any fact, and rows without an order, go
    to plain side tables, which many tasks read and partial aggregates collapse; all others to ``buckets``
    sorted buckets, whose joins and per-order aggregates need no shuffle.
    An order lies on one side in every fact, so the sides never meet.  All tables are
    stored when first used (the hot orders then need a count of every fact).
    """
    base = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/mercato-stage"
    tag = hashlib.sha1(f"{state}|{buckets}|{hot_rows}|parts".encode()).hexdigest()[:16]
    plain = stage_tables(spark, tables, state, folder)

    def hot() -> DataFrame:
        path = f"{base}/{tag}/hot-orders"
        memo = (spark.sparkContext.applicationId, path)
        if memo not in _READ_BACK:
            _store_once(spark, hot_keys((getattr(tables, n) for n in ORDER_FACTS), "order_id",
                                        hot_rows), path)
            _READ_BACK[memo] = read_table(spark, path)
        return _READ_BACK[memo]

    def fact(side: str, name: str) -> DataFrame:
        path = f"{base}/{tag}/{name}-{side}"
        memo = (spark.sparkContext.applicationId, path)
        if memo not in _READ_BACK:
            df = getattr(tables, name)
            if side == "hot":
                rows = df.join(hot(), "order_id", "left_semi").unionByName(df.where("order_id IS NULL"))
                _store_once(spark, rows.select(df.columns), path)
                _READ_BACK[memo] = read_table(spark, path)
            else:
                rows = df.where("order_id IS NOT NULL").join(hot(), "order_id", "left_anti")
                _READ_BACK[memo] = _bucketed(spark, rows.select(df.columns), path,
                                             f"mercato_{tag}_{name}", buckets, "order_id")
        return _READ_BACK[memo]

    parts = [LazyTables({n: partial(fact, side, n) for n in ORDER_FACTS})
             for side in ("bucketed", "hot")]
    return LazyTables.of_parts(parts, plain)
