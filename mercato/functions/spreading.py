"""As many tasks as the rows need for steps per key, whatever the session's shuffle partitions.

A step that groups, joins or sorts by a key in ``spark.sql.shuffle.partitions`` tasks holds
more rows in each as the input grows, and spills.  Here rows are partitioned by the key in
tasks of about ``TASK_ROWS`` rows: an aggregate, a window or the other side of a join on that
key then needs no further shuffle.  Rows of keys too large for one task, and rows without
a key, are kept apart, where partial aggregates collapse them before a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key above which it is kept apart, and rows that one task sorts at most
#: (about 100 bytes each, so that a sort stays in memory).
HOT_KEY_ROWS, TASK_ROWS = 100_000, 500_000

#: Bins of hashed keys that are counted before single keys are.
BINS = 65_536


class Spread(NamedTuple):
    """Tasks for a key; its hot values, if any; whether there are rows without a key."""

    tasks: int
    hot: DataFrame | None
    nulls: bool


def large_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Values of ``key`` with more than ``rows`` rows.

    Rows are counted in bins of hashed keys first, at most ``BINS`` groups; only keys of a bin
    with more rows, which holds every such key, are counted one by one."""
    binned = (df.where(F.col(key).isNotNull())
              .select(key, F.pmod(F.xxhash64(key), F.lit(BINS)).alias("_bin")))
    full = (binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
            .select("_bin"))
    # a proven bound: one row for each bin
    return (binned.join(F.broadcast(full), "_bin", "left_semi").groupBy(key)
            .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(key))


def spread_plan(bases: Sequence[DataFrame], key: str, hot_rows: int | None = None,
                task_rows: int | None = None) -> Spread | None:
    """How to spread frames by ``key``; None where the session's shuffle partitions do.

    ``bases`` are stored tables that bound what is spread: of every key they hold as many
    rows or more.  Runs a count, and where rows are to be spread a search for hot keys (at
    most one for each ``hot_rows`` rows of a base)."""
    from mercato.session import ensure_checkpoint_dir
    spark = bases[0].sparkSession
    counts = [b.agg(F.count(F.lit(1)), F.count(key)).first() for b in bases]
    tasks = max(-(-n // (task_rows or TASK_ROWS)) for n, _ in counts)
    if tasks <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return None
    ensure_checkpoint_dir(spark)
    hot = reduce(DataFrame.union, [large_keys(b, key, hot_rows or HOT_KEY_ROWS) for b in bases])
    hot = hot.distinct().checkpoint(eager=True)
    return Spread(tasks, None if hot.isEmpty() else hot, any(n > keyed for n, keyed in counts))


def spread(df: DataFrame, key: str, plan: Spread | None) -> list[DataFrame]:
    """``df`` in parts that share no value of ``key``: its ordinary rows partitioned by ``key`` in
    the plan's tasks, and the rows kept apart, if there may be any."""
    if plan is None:
        return [df]
    rest, apart = df.where(F.col(key).isNotNull()), []
    if plan.hot is not None:
        # a proven bound: one row for each ``hot_rows`` rows
        hot = F.broadcast(plan.hot)
        apart.append(rest.join(hot, key, "left_semi").select(df.columns))
        rest = rest.join(hot, key, "left_anti").select(df.columns)
    if plan.nulls:
        apart.append(df.where(F.col(key).isNull()))
    rest = rest.repartition(plan.tasks, key)
    return [rest, reduce(DataFrame.unionByName, apart)] if apart else [rest]
