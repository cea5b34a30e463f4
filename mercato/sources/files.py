"""Reading the original export and storing / re-reading derived tables.

S1 full scans of named tables, S3 create-or-replace sinks, S4 read-back of a
stored result, S5 update of the rows that match a condition.  Paths are folders on
storage that the driver and all executors share.

A stored table is a folder of numbered versions.  Each write makes a data folder
and, once that is complete, commits it as the next number: the commit file
is renamed into place only if no file of that number exists, so of two writers that
start from one version one commits and the other gets a :class:`ConflictError`.  A failed write
leaves the table as it was, and a plan that reads a version keeps its files when
the table is replaced, even by itself.

An update is copy-on-write by file: only files that hold a matching row are rewritten, and
the new version's manifest lists the new files beside the old ones that stay.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.sources.schema import SOURCE_SCHEMAS, check_contract
from mercato.sources.tables import Tables

TABLE_NAMES = ("customers", "orders", "items", "payments", "reviews",
               "products", "translation", "sellers")
COMMITS, MANIFEST = "_commits", "_files"


class ConflictError(RuntimeError):
    """Another writer committed the version this one was about to commit."""


def read_export(spark: SparkSession, folder: str, fmt: str = "parquet",
                files: dict[str, str] | None = None) -> Tables:
    """The eight tables of an export, read with explicit schemas.

    ``files`` maps a table name to its file stem in ``folder`` (default: the
    table name itself); ``fmt`` is ``parquet`` or ``csv`` (header row).
    """
    files = files or {}
    frames = {}
    for name in TABLE_NAMES:
        stem = files.get(name, name)
        reader = spark.read.schema(SOURCE_SCHEMAS[name])
        if fmt == "csv":
            df = reader.option("header", "true").csv(f"{folder}/{stem}.csv")
        else:
            df = reader.parquet(f"{folder}/{stem}.parquet")
        frames[name] = check_contract(name, df)
    return Tables(**frames)


def _hadoop(spark: SparkSession, path: str):
    """(path, its file system) of any store Spark can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[int]:
    folder, fs = _hadoop(spark, f"{path}/{COMMITS}")
    if not fs.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def version_number(spark: SparkSession, path: str) -> int:
    """The number of the current version; 0 where there is none."""
    return max(_commits(spark, path), default=0)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The data folder of the current version of a stored table, if any."""
    number = version_number(spark, path)
    if not number:
        return None
    commit, fs = _hadoop(spark, f"{path}/{COMMITS}/{number:012d}")
    stream = fs.open(commit)
    try:
        return f"{path}/{stream.readUTF()}"
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, folder: str, number: int) -> None:
    """Make ``folder`` version ``number``, unless there is one."""
    new, fs = _hadoop(spark, f"{path}/{COMMITS}/_new-{uuid.uuid4().hex}")
    stream = fs.create(new, False)
    try:
        stream.writeUTF(folder)
    finally:
        stream.close()
    target, _ = _hadoop(spark, f"{path}/{COMMITS}/{number:012d}")
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    keep = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            fs.makeQualified(new).toUri(), spark._jsc.hadoopConfiguration()).rename(
                fs.makeQualified(new), fs.makeQualified(target), keep)
    except Py4JJavaError as e:
        if not fs.exists(target):
            raise
        fs.delete(new, False)
        raise ConflictError(f"version {number} of {path} was committed by another writer; "
                            "read the table again and repeat the write") from e


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                base: int | None = None) -> int:
    """S3: create or replace a stored table; readers see it once it is whole.

    ``base`` is the version number the write starts from (default: the current
    one when it begins); if another was committed since, it is a ConflictError.
    Returns the new version's number."""
    spark = df.sparkSession
    base = version_number(spark, path) if base is None else base
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{version}")
    _commit(spark, path, version, base + 1)
    return base + 1


def _manifest(spark: SparkSession, version: str) -> list[str] | None:
    """The files of a version that does not consist of its own folder alone."""
    folder, fs = _hadoop(spark, f"{version}/{MANIFEST}")
    if not fs.exists(folder):
        return None
    return [r.value for r in spark.read.text(folder.toString()).collect()]  # one row for each file


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read back the current version of a stored table (or a plain folder)."""
    version = current_version(spark, path)
    files = _manifest(spark, version) if version else None
    return spark.read.parquet(*files) if files else spark.read.parquet(version or path)


def _same_scheme(path: str) -> str:
    """Local files are named ``file:/x`` in one place and ``file:///x`` in another."""
    return "file:/" + path[5:].lstrip("/") if path.startswith("file:") else path


def update_table(spark: SparkSession, path: str, where: Column, values: dict[str, Column],
                 base: int | None = None) -> int:
    """Set columns in the rows of a stored table that match ``where``.

    Files without a matching row stay as they are, whatever their number; the others are
    rewritten and committed with them as the next version (a ConflictError if another writer was first).
    Returns how many files were rewritten.  Tables stored with ``partition_by`` are not
    supported: their files alone lack the partition columns."""
    base = version_number(spark, path) if base is None else base
    table = read_table(spark, path)
    every = sorted(map(unquote, table.inputFiles()))  # names are given as URIs
    if any("=" in part for f in every for part in f[f.rfind("/v-"):].split("/")[:-1]):
        raise ValueError(f"{path} is stored in partitions; replace it instead")
    # one row for each file
    hit = {_same_scheme(unquote(r.f)) for r in table.where(where).select(
        F.col("_metadata.file_path").alias("f")).distinct().collect()}
    touched = [f for f in every if _same_scheme(f) in hit]
    if len(touched) != len(hit):
        raise RuntimeError(f"files of {path} cannot be told apart: {sorted(hit)[:3]}")
    if not touched:
        return 0
    version = f"v-{uuid.uuid4().hex}"
    rows = spark.read.schema(table.schema).parquet(*touched)
    new = [F.when(where, values[c]).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c)
           if c in values else F.col(c) for c in rows.columns]
    rows.select(*new).write.mode("errorifexists").parquet(f"{path}/{version}")
    written = spark.read.schema(table.schema).parquet(f"{path}/{version}").inputFiles()
    files = [f for f in every if f not in set(touched)] + [unquote(f) for f in written]
    spark.createDataFrame([(f,) for f in files], "value string").coalesce(1).write.text(
        f"{path}/{version}/{MANIFEST}")
    _commit(spark, path, version, base + 1)
    return len(touched)


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete all versions whose files the current one does not use; nothing may
    still read them."""
    folder, fs = _hadoop(spark, path)
    current, gone = current_version(spark, path), 0
    if current is None:
        return 0
    used = {current.rsplit("/", 1)[1]} | {f.rsplit("/", 2)[1] for f in _manifest(spark, current) or ()}
    for number in _commits(spark, path)[:-1]:
        fs.delete(_hadoop(spark, f"{path}/{COMMITS}/{number:012d}")[0], False)
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("v-") and name not in used:
            fs.delete(entry.getPath(), True)
            gone += 1
    return gone


def input_state(spark: SparkSession, paths: list[str]) -> str:
    """Names, lengths and modification times of the files under ``paths``: equal as
    long as the inputs are."""
    seen = []
    for path in paths:
        p, fs = _hadoop(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return "|".join(sorted(seen))
