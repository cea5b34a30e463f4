"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but
the last return the columns of ``docs``.

Decisions are of rows, not of ids: they are joined back by the id (null is an id
like others) and the text together, the text by its 64-bit hash.  So a rejected
row never takes another text of its id with it, rows without an id are judged like all others, and
rows equal in both share one decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import decontaminate, mixing, simhash, tokens, toxicity
from mercato.llm.common import stored, table
from mercato.llm.linededup import text_hash
from mercato.llm.queries import tokenizer_path


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, one number for each id and text."""
    return docs.withColumn("_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")),
                                              text_hash(F.col("text"))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    bad = stored(scored.where("predicted = 1").select("doc_id", "text_hash"), "rejected").distinct()
    bad = bad.toDF("_id", "_hash")
    return docs.join(bad, docs.doc_id.eqNullSafe(bad["_id"]) & (text_hash(docs.text) == bad["_hash"]),
                     "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once
    (without any id: one of them)."""
    keyed = _keyed(docs)
    linked = stored(simhash.near_duplicates(keyed, "_key", shingle=3, max_distance=3)
                    .select(F.col("doc_id").alias("_key"), "component_id").distinct(), "linked")
    ids = keyed.select("_key", "doc_id").join(linked, "_key")
    # a group's size does not matter: its smallest is found before the shuffle, too
    first = ids.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first"))
    first = stored(first.select("first._key"), "kept")
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    keyed = _keyed(docs)
    found = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), window=10, id_col="_key")
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("_key")), "rejected").distinct()
    return keyed.join(bad, "_key", "left_anti").drop("_key")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take go."""
    often = stored(mixing.copies(mixing.mix(docs)).where("copies > 0"), "copies")
    hashed = docs.withColumn("_th", text_hash(F.col("text")))
    picked = (hashed.join(often.toDF("_id", "_th2", "_copies"),
                          hashed.doc_id.eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_th2")))
              .dropDuplicates(["doc_id", "_th"]))
    return (picked.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*docs.columns))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus, and each document's place in them."""
    return tokens.token_files(docs, tokenizer_path(), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: SQL has no SimHash, tokenizer or nearest-example search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each over the stored output of the one before."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs
