"""Shared helpers: input tables, the shared folder, stored steps, text buffers.

Files that tasks write or read themselves live under the folder the session
names in ``spark.checkpoint.dir`` (see ``mercato.session``) and are reached
through ``pyarrow.fs``, so local, HDFS and object-store folders work alike.
A task that is retried writes new, uniquely named files; only the files named
in the rows of a finished Spark write are ever read.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import ensure_checkpoint_dir

#: Bytes of text handled at a time inside a task.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, fully qualified folder under the session's shared folder."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(
        f"{ensure_checkpoint_dir(spark).rstrip('/')}/mercato-llm/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    uri = fs.makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start
    from files, whatever happens to the executors that made them."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    # zstd works on the heap; snappy's direct buffers pile up over many small files
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(df_or_folder: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete the files behind a :func:`stored` step that nothing reads any more."""
    if isinstance(df_or_folder, str):
        folders = [df_or_folder]
    else:
        spark = df_or_folder.sparkSession
        folders = sorted({f.rsplit("/", 1)[0] for f in df_or_folder.inputFiles()})
    jvm = spark._jvm
    for folder in folders:
        if "/mercato-llm/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a fully qualified URI."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def give_back() -> None:
    """Hand memory that this process has freed back to the system: the allocators
    of Arrow and of the C library (glibc) keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over a task's batches, then :func:`give_back`: a Python worker lives on
    beside the tasks of later steps, and would hold the most it ever needed."""
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidy


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow column; null is empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + counts[i] - 1`` for each i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(counts) - counts
    at = np.repeat(starts - first, counts)
    at += np.arange(total, dtype=np.int64)
    return at


def labelled(labels: DataFrame, label: str, mod: int, held: int, train: bool) -> DataFrame:
    """``labels`` rows with a value, split by crc32 of the id as text: the
    remainder ``held`` is held out, all others train.  A document labelled
    more than once counts as positive if most of its labels are."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod
    rows = (labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("label"))
            .where("doc_id IS NOT NULL AND label IS NOT NULL"))
    rows = rows.where(fold != held) if train else rows.where(fold == held)
    return rows.groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
