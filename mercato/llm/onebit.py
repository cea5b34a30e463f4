"""Nearest neighbours over randomly rotated one-bit codes (operator 5).

``build_index`` codes every vector: less its nearest centroid (from a k-means of
a bounded sample), scaled to unit length, turned by one random rotation, and cut
to its signs, packed in 64-bit words.  Beside the code it keeps two scalars,
the distance to the centroid and the inner product of the unit vector with its code.

``search`` estimates inner products from popcounts of the code with the bit
planes of the query (rounded to ``query_bits`` bits); the scalars correct them and
bound their error.  Vectors whose lower bound of the distance does not exceed
the k-th best are ranked again by the exact distance of the original
vectors, in double precision.  Every code is looked at; nothing is pruned but by
its bound, which holds with high probability (``epsilon`` standard deviations).

Queries are stored and read by the tasks in blocks.  A first pass over a
sample of the index gives each query a valid bound on its k-th distance, so
that the pass over all rows emits few candidates per task.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
parts take part neither as rows nor as queries; vectors of another length than
the query are no candidates; rows with the query's own id are none either;
ties go to the smaller id; repeated rows are candidates of their own, but ask
as one query (the smallest vector of an id); no rows give no rows; only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import file_system, shared_folder, stored

#: Vectors the centroids are fitted on, at most; centroids; rows and queries of a block.
SAMPLE, CENTROIDS, ROWS, QUERIES = 8_192, 16, 4_096, 256
#: Every so many rows (by hash) are in the first pass.
FIRST_PASS = 32
#: Vector lengths whose results are held as one plan.
LENGTHS = 16


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows whose vector can take part."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.select(F.col(id_col).cast("long").alias("id"),
                        F.col(vector_col).cast("array<double>").alias("v"))
            .where("id IS NOT NULL AND v IS NOT NULL").where(good)
            .where(F.exists("v", lambda x: x != 0)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = _nearest(x, centre)
        for j in range(len(centre)):
            if (near == j).any():
                centre[j] = x[near == j].mean(0)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre ** 2).sum(1) - 2 * x @ centre.T, axis=1)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as 64-bit words."""
    pad = -bits.shape[1] % 64
    wide = np.pad(bits.astype(np.uint8), ((0, 0), (0, pad)))
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


class Coder:
    """The rotation and the centroids of one vector length."""

    def __init__(self, sample: np.ndarray, centroids: int, seed: int):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.turn = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
        self.centre = _kmeans(sample, centroids, rng)
        self.turned_centre = self.centre @ self.turn

    def encode(self, x: np.ndarray):
        """(centroid, code words, distance to it, inner product with the code)."""
        near = _nearest(x, self.centre)
        r = x @ self.turn - self.turned_centre[near]
        norm = np.sqrt((r * r).sum(1))
        unit = r / np.where(norm > 0, norm, 1)[:, None]
        own = np.abs(unit).sum(1) / np.sqrt(self.dim)
        return near, _pack(r > 0), norm, np.where(norm > 0, own, 1.0)


def build_index(rows: DataFrame, dim: int, centroids: int = CENTROIDS,
                seed: int = 11) -> tuple[DataFrame, Coder]:
    """The stored index over (id, v) rows of length ``dim``."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    coder = Coder(_matrix(sample["v"].combine_chunks(), dim), centroids, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near, words, norm, own = coder.encode(_matrix(batch.column(1), dim))
            at = pa.array(np.arange(len(near) + 1, dtype=np.int32) * words.shape[1])
            code = pa.ListArray.from_arrays(at, pa.array(words.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), code,
                 pa.array(norm), pa.array(own)], names=["id", "v", "centroid", "code", "norm", "own"])

    return stored(rows.mapInArrow(run, "id long, v array<double>, centroid int, code array<long>, "
                                  "norm double, own double"), "one-bit-index"), coder


def _bounds(coder: Coder, q: np.ndarray, j: int, words: np.ndarray, norm: np.ndarray,
            own: np.ndarray, bits: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the squared distances of queries to coded rows of centroid j."""
    r = q @ coder.turn - coder.turned_centre[j]
    length = np.sqrt((r * r).sum(1))
    unit = r / np.where(length > 0, length, 1)[:, None]
    low = unit.min(1)
    step = np.maximum((unit.max(1) - low) / ((1 << bits) - 1), 1e-300)
    level = np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint32)
    rounding = np.sqrt(((unit - (low[:, None] + level * step[:, None])) ** 2).sum(1))
    both = np.zeros((len(q), len(words)))
    for b in range(bits):
        plane = _pack((level >> b) & 1)
        for w in range(words.shape[1]):
            both += float(1 << b) * np.bitwise_count(plane[:, w, None] & words[None, :, w])
    ones = np.bitwise_count(words).sum(1)
    signs = 2 * (both * step[:, None] + low[:, None] * ones) - (
        level.sum(1) * step + low * coder.dim)[:, None]
    estimate = signs / np.sqrt(coder.dim) / own
    error = epsilon * np.sqrt(np.maximum(1 - own ** 2, 0)) / own / np.sqrt(max(coder.dim - 1, 1))
    error = error[None, :] + rounding[:, None] / own[None, :]
    base = norm[None, :] ** 2 + length[:, None] ** 2
    scale = 2 * norm[None, :] * length[:, None]
    return base - scale * (estimate + error), base - scale * (estimate - error)


def _search(index: DataFrame, coder: Coder, queries: str, k: int, bits: int,
            epsilon: float) -> DataFrame:
    """(query_id, vec_id, score): each task's nearest of its own rows, for each stored query
    (id, v, bound), no further than the query's bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(queries)
        files = [f.path for f in fs.get_file_info(_selector(base)) if f.path.endswith(".parquet")]
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                rows = batch.slice(a, ROWS)
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                x = _matrix(rows.column(1), coder.dim)
                near = rows.column(2).to_numpy(zero_copy_only=False)
                words = rows.column(3).flatten().to_numpy(zero_copy_only=False).view(
                    np.uint64).reshape(len(ids), -1)
                norm, own = (rows.column(c).to_numpy(zero_copy_only=False) for c in (4, 5))
                for path in sorted(files):
                    with fs.open_input_file(path) as f:
                        for block in pq.ParquetFile(f).iter_batches(batch_size=QUERIES):
                            yield from find(block, ids, x, near, words, norm, own)

    def find(block, ids, x, near, words, norm, own):
        query_id = block.column(0).to_numpy(zero_copy_only=False)
        q = _matrix(block.column(1), coder.dim)
        bound = block.column(2).to_numpy(zero_copy_only=False)
        low, high = (np.empty((len(q), len(ids))) for _ in range(2))
        for j in np.unique(near):
            at = np.flatnonzero(near == j)
            low[:, at], high[:, at] = _bounds(coder, q, j, words[at], norm[at], own[at], bits, epsilon)
        same = query_id[:, None] == ids[None, :]
        low[same] = high[same] = np.inf
        limit = bound ** 2 * (1 + 1e-9)
        if len(ids) > k:
            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
        out = []
        for i in range(len(q)):
            at = np.flatnonzero((low[i] <= limit[i]) & ~same[i])
            exact = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
            best = np.lexsort([ids[at], exact])[:k]
            best = best[exact[best] <= bound[i]]
            out.append((np.full(len(best), query_id[i]), ids[at][best], exact[best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
             pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def _selector(base: str):
    from pyarrow import fs
    return fs.FileSelector(base)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _write_queries(spark, queries: DataFrame) -> str:
    folder = shared_folder(spark, "one-bit-queries")
    queries.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return folder


def search(rows: DataFrame, queries: DataFrame, k: int = 10, query_bits: int = 6,
           epsilon: float = 3.0, id_col: str = "vec_id", vector_col: str = "embedding",
           centroids: int = CENTROIDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query."""
    spark = rows.sparkSession
    good = stored(valid_vectors(rows, id_col, vector_col), "vectors")
    ask = stored(valid_vectors(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")),
                 "queries")
    # one row for each length
    lengths = [r[0] for r in ask.select(F.size("v")).distinct().collect()]
    found, held = None, 0
    for dim in sorted(lengths):
        own = good.where(F.size("v") == dim)
        if not own.limit(1).count():
            continue
        index, coder = build_index(own, dim, centroids)
        mine = ask.where(F.size("v") == dim).select("id", "v")
        first = _write_queries(spark, mine.withColumn("bound", F.lit(float("inf"))))
        sample = index.where(F.pmod(F.xxhash64("id"), F.lit(FIRST_PASS)) == 0)
        near = _search(sample, coder, first, k, query_bits, epsilon)
        kth = (_top(near, k).where(F.col("rank") == k)
               .select(F.col("query_id").alias("id"), F.col("score").alias("bound")))
        second = _write_queries(spark, mine.join(kth, "id", "left").select(
            "id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound")))
        part = _search(index, coder, second, k, query_bits, epsilon)
        found = part if found is None else found.unionByName(part)
        held += 1
        if held % LENGTHS == 0:
            found = stored(found, "near")
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
