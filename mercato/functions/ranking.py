"""Top-k and first-per-key helpers.

Global top-k is ``orderBy().limit()`` (TakeOrderedAndProject: each task keeps
k rows, so nothing large reaches one task).  Per-key selection uses a window
whose partial WindowGroupLimit runs before the shuffle.  Callers always pass
a total order so results do not depend on the order rows arrive in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.spreading import HOT_KEY_ROWS, TASK_ROWS, large_keys

OrderSpec = Sequence[Column | str]


def top_k(df: DataFrame, k: int, order: OrderSpec) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: OrderSpec) -> DataFrame:
    """One row per key: the first in ``order`` (QUALIFY row_number() = 1)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: OrderSpec, k: int,
                    ties: bool = False, rank_col: str | None = None) -> DataFrame:
    """Rows ranked ``<= k`` within each key; ``ties=True`` uses rank()."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fn = F.rank() if ties else F.row_number()
    out = df.withColumn("_rk", fn.over(w)).filter(F.col("_rk") <= k)
    return out.withColumnRenamed("_rk", rank_col) if rank_col else out.drop("_rk")


def asc(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def desc(c: str) -> Column:
    return F.col(c).desc_nulls_last()



def row_number_split(df: DataFrame, key: str, order: Sequence[str], name: str,
                     pieces: int | None = None, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """``row_number() OVER (PARTITION BY key ORDER BY order)`` without
    sending a large key group to one task; rows with a null key are left out.

    Keys with more than ``hot_rows`` rows are found by counts (``large_keys``) and stored (at
    most one for each ``hot_rows`` rows).  All other rows cross the network once, for
    the plain window, in tasks of about ``TASK_ROWS`` rows.  The rows of hot keys alone
    are numbered in pieces:

    1. Range-partition on ``(key, *order)``: a large group spans several
       partitions, each holding a contiguous run of its order.
    2. Number rows within each (partition, key) piece; a hash exchange on
       both splits a large group into its pieces.
    3. Store that result with ``checkpoint()`` (the session's checkpoint
       folder): both uses below must see the same partition numbers.
    4. Each piece's offset is the size of the key's earlier pieces (one row
       per piece, at most ``pieces`` per key), joined back on (key, piece).

    Runs jobs when called (the counts; with hot keys the checkpoint).  Equal to the plain
    window whenever ``order`` is a total order within the key.
    """
    from mercato.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    df = df.where(F.col(key).isNotNull())
    hot = large_keys(df, key, hot_rows).checkpoint(eager=True)
    tasks, n = -(-df.count() // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some_hot = not hot.isEmpty()
    # a proven bound: one row for each ``hot_rows`` rows
    rest = df.join(F.broadcast(hot), key, "left_anti") if some_hot else df
    rest = rest.repartition(tasks, key) if tasks > n else rest
    numbered = rest.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    if not some_hot:
        # a union all the same: a later step per key then limits its rows before a shuffle of its own
        none = [F.col(f.name) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name)
                for f in numbered.schema.fields]
        return numbered.unionByName(hot.select(none))
    split = _numbered_in_pieces(df.join(F.broadcast(hot), key, "left_semi"), key, order, name,
                                pieces or max(n, tasks))
    return numbered.unionByName(split)


def _numbered_in_pieces(df: DataFrame, key: str, order: Sequence[str], name: str,
                        pieces: int) -> DataFrame:
    ranged = (df.repartitionByRange(pieces, key, *order)
              .withColumn("_piece", F.spark_partition_id()))
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_piece", key).orderBy(*order)))
    local = local.checkpoint(eager=True)
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (local.groupBy(key, "_piece").agg(F.count(F.lit(1)).alias("_size"))
               .withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
               .select(key, "_piece", "_offset"))
    return (local.join(offsets, [key, "_piece"])
            .withColumn(name, (F.col("_offset") + F.col("_local")).cast("int"))
            .drop("_piece", "_local", "_offset"))


def rank_ranged(df: DataFrame, order: Sequence[tuple[str, bool]], name: str,
                pieces: int | None = None) -> DataFrame:
    """``rank() OVER (ORDER BY order)`` without sending all rows to one task.

    ``order`` holds (column, descending) pairs; nulls come last, NaN above all numbers.

    1. Range-partition on the order and a hash of the row: every piece is a run of
       the order, and rows that tie, however many, span pieces too.
    2. Rank within pieces, stored with ``checkpoint()``: both uses below must see
       the same pieces.
    3. One row for each piece gives its size, first and last values and how many rows hold the
       last.  A piece's offset is the size of the earlier ones.  Values that a piece begins
       with may have begun in an earlier one: then they are the last values of that piece,
       and their rank is carried from where they start.

    Runs one job when called (the checkpoint).  The summary is at most ``pieces``
    rows, put in order in one array.
    """
    from mercato.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [desc(c) if down else asc(c) for c, down in order]
    keys = F.struct(*(F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(order)))
    within = Window.partitionBy("_piece").orderBy(*by)
    local = (df.withColumn("_salt", F.xxhash64(*df.columns)).repartitionByRange(n, *by, "_salt")
             .withColumn("_piece", F.spark_partition_id()).drop("_salt")
             .withColumn("_local", F.rank().over(within).cast("long")).withColumn("_keys", keys)
             .checkpoint(eager=True))
    ends = local.groupBy("_piece").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("_keys", "_local").alias("first"),
        F.max("_local").alias("last_at"), F.max_by("_keys", "_local").alias("last"))
    every = ends.agg(F.array_sort(F.collect_list(F.struct(
        "_piece", "size", "last_at", "first", "last"))).alias("p"))
    sizes = lambda p, i: F.aggregate(F.slice(p, 1, i), F.lit(0).cast("long"),
                                     lambda total, e: total + e["size"])
    offsets = every.select(F.transform("p", lambda e, i: F.struct(
        e["_piece"].alias("_piece"), sizes(F.col("p"), i).alias("offset"), e["first"].alias("first"),
        e["last"].alias("last"), e["last_at"].alias("last_at"))).alias("p"))
    begun = lambda e: F.array_min(F.transform(
        F.filter("p", lambda f: f["last"].eqNullSafe(e["first"])), lambda f: f["offset"] + f["last_at"]))
    carried = offsets.select(F.explode(F.transform("p", lambda e: F.struct(
        e["_piece"].alias("_piece"), e["offset"].alias("_offset"), e["first"].alias("_first"),
        begun(e).alias("_begun")))).alias("e")).select("e.*")
    rank = F.when(F.col("_keys").eqNullSafe(F.col("_first")) & F.col("_begun").isNotNull(),
                  F.col("_begun")).otherwise(F.col("_offset") + F.col("_local"))
    return (local.join(carried, "_piece").withColumn(name, rank)
            .drop("_piece", "_local", "_keys", "_offset", "_first", "_begun"))


def rank_in_groups(df: DataFrame, first: str, rest: Sequence[str], name: str) -> DataFrame:
    """``rank() OVER (ORDER BY first DESC, rest DESC)``, nulls last, for a ``first`` of few
    distinct values: ranks within each value, and the rows of greater values added.

    Lazy; ``df`` is read twice.  The values and their row counts are put in order in one
    array, the rows of one value in one task.
    """
    sizes = df.groupBy(F.col(first).alias("_value")).agg(F.count(F.lit(1)).alias("size"))
    every = sizes.agg(F.sort_array(F.collect_list(F.struct("_value", "size")), asc=False).alias("p"))
    offsets = every.select(F.explode(F.transform("p", lambda e, i: F.struct(
        e["_value"].alias("_value"),
        F.aggregate(F.slice("p", 1, i), F.lit(0).cast("long"), lambda n, f: n + f["size"])
        .alias("_offset")))).alias("e")).select("e.*")
    within = F.rank().over(Window.partitionBy(first).orderBy(*[desc(c) for c in rest]))
    return (df.withColumn("_local", within)
            .join(offsets, F.col(first).eqNullSafe(F.col("_value")))
            .withColumn(name, F.col("_offset") + F.col("_local")).drop("_value", "_offset", "_local"))
