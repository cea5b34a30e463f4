"""Line de-duplication over levelled sorted runs (operator 9, DataFrame only).

A :class:`LineStore` holds the hashes of all lines seen so far as sorted runs.
Each new batch of documents is reduced to one row for each line hash, which
is merge-anti-joined with the runs: hashes found there were seen in an earlier
batch, the rest form the batch's own run on level 0.  When a level holds
``fan_in`` runs they are merged into one sorted run on the next level, so
there are never more than a few runs however many batches came before.

A line's key is the line stripped of ASCII white space at both ends and with
A-Z lower-cased.  Keys of at least ``min_chars`` characters lose all their
lines but those in the first document: of earlier batches first, within one
batch the smallest id.  Batches are cut by ascending id, so that is the
smallest id of all.

Hashes are 96 bits (two independent functions).  A frequent line is reduced
by partial aggregation before each shuffle, and only lines known to repeat
are joined back to their documents, from stored tables, so adaptive execution
can split a hot line.

Defined cases: null or empty text is one empty line; documents without an id
keep all their lines; rows with the same id are one document, but each row's
text is filtered on its own; no rows give no rows; only the id and text
columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import discard, stored

SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, th, line, h1, h2) for each line long enough to count."""
    rows = (docs.where("id IS NOT NULL")
            .select("id", text_hash(F.col("text")).alias("th"), F.posexplode(_lines(F.col("text"))))
            .withColumn("key", F.trim("col", F.lit(SPACE)))
            .where(F.char_length("key") >= min_chars)
            .withColumn("key", line_key(F.col("col"))))
    return rows.select("id", "th", F.col("pos").alias("line"), F.xxhash64("key").alias("h1"),
                       F.hash("key").alias("h2"))


class LineStore:
    """The runs of line hashes of all batches added so far."""

    def __init__(self, spark: SparkSession, fan_in: int = 2):
        self.spark, self.fan_in = spark, fan_in
        self.levels: list[list[DataFrame]] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _put(self, run: DataFrame, level: int) -> None:
        """Store a sorted run; merge a level that is full into the next."""
        run = stored(run.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2"),
                     f"line-run-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            merged = old[0]
            for other in old[1:]:
                merged = merged.unionByName(other)
            self._put(merged, level + 1)
            for r in old:
                discard(r)

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of :func:`hashed_lines`; returns its lines to drop: (id, th, line)."""
        keys = lines.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
        for run in self.runs:
            keys = keys.join(run.select("h1", "h2", F.lit(True).alias("hit")), ["h1", "h2"], "left")
            keys = (keys.withColumn("owner", F.when(F.col("hit").isNull(), F.col("owner")))
                    .drop("hit"))
        keys = stored(keys, "line-keys")
        repeated = (keys.where("owner IS NULL OR owner < last").select("h1", "h2", "owner"))
        drops = stored(lines.join(repeated, ["h1", "h2"])
                       .where("owner IS NULL OR id != owner").select("id", "th", "line"),
                       "line-drops")
        self._put(keys.where("owner IS NOT NULL").select("h1", "h2"), 0)
        discard(keys)
        return drops


def without(lines: Column, drops: Column) -> Column:
    """The lines of an array left when those at the ascending positions
    ``drops`` go: the stretches between them, put together."""
    before = F.concat(F.array(F.lit(-1)), drops)
    after = F.concat(drops, F.array(F.size(lines)))
    return F.flatten(F.zip_with(before, after, lambda p, q: F.slice(lines, p + 2, q - p - 1)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 10, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each row's text without the lines
    an earlier document holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1_000)
                    ).first()[0] if batches > 1 else None
    cuts = cuts or []
    batch = sum((F.when(F.col("id") >= int(c), 1).otherwise(0) for c in cuts), F.lit(0))
    lines = stored(hashed_lines(rows, min_chars).withColumn("batch", batch), "lines")
    store, drops = LineStore(spark, fan_in), []
    for b in range(len(cuts) + 1):
        drops.append(store.add(lines.where(F.col("batch") == b).drop("batch")))
    every = drops[0]
    for more in drops[1:]:
        every = every.unionByName(more)
    # at most a document's own lines; sorted as ``without`` needs them
    gone = every.distinct().groupBy("id", "th").agg(F.array_sort(F.collect_list("line")).alias("drops"))
    out = (rows.withColumn("th", text_hash(F.col("text"))).join(gone, ["id", "th"], "left")
           .withColumn("lines", _lines(F.col("text"))))
    lines, drops = F.col("lines"), F.col("drops")
    return out.select(
        F.col("id").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"),
        F.when(drops.isNull(), 0).otherwise(F.size(drops)).cast("long").alias("n_dropped"),
        F.when(drops.isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(without(lines, drops), "\n")).alias("kept"))
