"""Quality scores from preference pairs, Bradley-Terry (operator 6).

Each document gets a vector of text statistics (shares of character classes and
single punctuation marks, word repetition, capitals, line shape).  Logistic loss on
the feature differences of all pairs of one good and one bad labelled document that is
not held out gives the weights of a linear score, so that the better of a pair
scores higher.  The threshold is the exact quantile of those documents' scores at their
share of bad ones; the reported score is a logistic curve around it, so 0.5 is
the threshold.

All pairs are counted in time linear in the documents: a pair's weight depends on its two
scores alone, so documents of one class and nearly one score (bins of 1/32, at
their mean score) enter as a sum.  Each Newton step is two passes of Spark over the
stored statistics of the labelled documents; the driver holds sums of bins only.  Sums are
of integers (units of 2^-24), so that they do not depend on the order of rows.

Defined cases: null and empty texts have all-zero statistics and a score
like any other; repeated rows give repeated results; with one class or no
labels every score is 0.5; only the id and text columns (and labels' id and
label) are read.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import rank_ranged
from mercato.llm.common import chunks, labelled, stored, text_bytes

#: Score bins per unit, the score beyond which bins end, and bins of a class.
FINE, FAR = 32, 30
BINS = 2 * FINE * FAR + 1
#: Fixed point of sums over documents.
UNIT = 2.0 ** 24
MARKS = string.punctuation


def _shares(texts: list[bytes]) -> np.ndarray:
    """Shares of character classes and marks among all bytes of each text."""
    size = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    cell = np.repeat(np.arange(len(texts), dtype=np.int64) << 8, size)
    cell += buf
    count = np.bincount(cell, minlength=len(texts) << 8).reshape(-1, 256).astype(float)
    span = lambda a, b: count[:, ord(a):ord(b) + 1].sum(1)
    lines = count[:, 10] + 1
    cols = [span("A", "Z"), span("a", "z"), span("0", "9"), count[:, 32], count[:, 10],
            count[:, 128:].sum(1), count[:, :32].sum(1) - count[:, 10]]
    cols += [count[:, ord(m)] for m in MARKS]
    share = np.stack(cols, 1) / np.maximum(size, 1)[:, None]
    return np.concatenate([share, np.log1p(size)[:, None] / 10,
                           np.log1p(size / lines)[:, None] / 10], 1)


def _word_shape(texts: list[bytes]) -> np.ndarray:
    """Shares of repeated, distinct, capital and short words, and mean word length."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    total = np.maximum(n, 1)
    per_doc = lambda w: np.bincount(doc, w, len(texts)) / total
    length = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    capital = np.array([w.isupper() and len(w) > 1 for w in names], float)
    alone = np.array([not any(c > 127 or chr(c).isalnum() for c in w) for w in names], float)
    again = np.zeros(len(code))
    if len(code) > 1:
        again[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    distinct = np.bincount(np.unique(doc * max(1, len(names)) + code) // max(1, len(names)),
                           minlength=len(texts)) / total
    if not len(code):
        return np.zeros((len(texts), 6))
    return np.stack([per_doc(again), distinct, per_doc(capital[code]), per_doc(alone[code]),
                     per_doc(length[code]) / 10, per_doc((length[code] <= 2).astype(float))], 1)


def statistics(texts: list[bytes]) -> np.ndarray:
    """The statistics of each text, with their square roots (small shares count)."""
    x = np.concatenate([_shares(texts), _word_shape(texts)], 1)
    return np.concatenate([x, np.sqrt(x)], 1).astype(np.float32)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<float>) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in chunks([len(t) for t in texts]):
                x = statistics(texts[a:b])
                at = pa.array(np.arange(b - a + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, x array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.threshold), -30, 30)))


#: Rows of sums for a batch of statistics and labels: (their numbers, the sums).
Part = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _by_number(number: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values`` rows that share a number."""
    if not len(number):
        return number, values
    order = np.argsort(number, kind="stable")
    number = number[order]
    start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    return number[start], np.add.reduceat(values[order], start, axis=0)


def _fit(total: Callable[[Part, int, int], np.ndarray], middle: Callable[[Callable, int, int], float],
         width: int, steps: int, decay: float) -> Model | None:
    """The model of rows of ``width`` statistics with 0/1 labels, of which
    ``total(part, n, m)`` gives ``n`` rows of ``m`` sums and ``middle(raw, k, n)`` the
    middle between the ``k``-th smallest of ``n`` raw scores and the next; None
    without both classes."""
    one_row = lambda *cols: (np.zeros(1, int), np.concatenate(cols)[None])
    first = total(lambda x, y: one_row([len(y), (y == 1).sum(), (y == 0).sum()], x.sum(0)), 1, width + 3)[0]
    n, good, bad = (round(v) for v in first[:3])
    if not good or not bad:
        return None
    mean = first[3:] / n
    scale = np.sqrt(total(lambda x, y: one_row(((x - mean) ** 2).sum(0)), 1, width)[0] / n)
    flat = scale <= 1e-6
    scale = np.where(flat, 1.0, scale)

    def paired(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scaled statistics of rows of either class, and their bins (bad ones first)."""
        x, y = x[(y == 0) | (y == 1)], y[(y == 0) | (y == 1)]
        z = (x - mean) / scale
        z[:, flat] = 0
        near = np.clip(np.rint(z @ w * FINE), -FINE * FAR, FINE * FAR).astype(int)
        return z, near + FINE * FAR + BINS * (y == 1)

    def binned(x, y, w):
        z, at = paired(x, y, w)
        return _by_number(at, np.column_stack([np.ones(len(z)), z]))

    def curved(x, y, w, weight):
        z, at = paired(x, y, w)
        return np.arange(width), (z * weight[at][:, None]).T @ z

    w = np.zeros(width)
    for _ in range(steps):
        sums = total(lambda x, y: binned(x, y, w), 2 * BINS, width + 1)
        at = np.flatnonzero(sums[:, 0] > 0.5)
        count, z = sums[at, 0], sums[at, 1:]
        b, g = at < BINS, at >= BINS
        score = z @ w / count
        # chance that a pair is wrong, for each bin of good and of bad documents
        p = 1 / (1 + np.exp(np.clip(score[g][:, None] - score[b], -30, 30)))
        share = p @ count[b] / bad, count[g] @ p / good
        grad = share[1] @ z[b] / bad - share[0] @ z[g] / good + decay * w
        q = p * (1 - p)
        weight = np.zeros(2 * BINS)
        weight[at[g]], weight[at[b]] = q @ count[b] / bad, count[g] @ q / bad
        cross = z[g].T @ q @ z[b] / bad
        outer = total(lambda x, y: curved(x, y, w, weight), width, width)
        hess = (outer - cross - cross.T) / good + decay * np.eye(width)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if grad @ step < 1e-9:  # twice what the loss can still fall by
            break

    def raw(x: np.ndarray) -> np.ndarray:
        return ((x - mean) / scale) @ w

    threshold = middle(raw, bad, n)
    spread = float(total(lambda x, y: one_row([np.abs(raw(x) - threshold).sum()]), 1, 1)[0, 0]) / n
    return Model(mean, scale, w, threshold, 4 / (spread or 1.0))


def bradley_terry(x: np.ndarray, label: np.ndarray, steps: int = 25,
                  decay: float = 1e-3) -> Model | None:
    """Fit on features and 0/1 labels; None without both classes."""
    def total(part: Part, n: int, m: int) -> np.ndarray:
        out = np.zeros((n, m))
        at, sums = part(x, label)
        out[at] = sums
        return out

    def middle(raw: Callable, k: int, n: int) -> float:
        order = np.sort(raw(x))
        return float((order[k - 1] + order[min(k, n - 1)]) / 2)

    return _fit(total, middle, x.shape[1], steps, decay)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a batch of (label, x) rows."""
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return (x.reshape(batch.num_rows, -1).astype(float),
            batch.column(0).to_numpy(zero_copy_only=False))


def bradley_terry_rows(rows: DataFrame, steps: int = 25, decay: float = 1e-3) -> Model | None:
    """:func:`bradley_terry` on all of ``rows`` (label, x), however many."""
    def total(part: Part, n: int, m: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, seen = np.zeros((n, m)), np.zeros(n, bool)
            for batch in batches:
                if batch.num_rows:
                    at, sums = part(*_arrays(batch))
                    out[at] += sums
                    seen[at] = True
            at = np.flatnonzero(seen)
            cell = (at[:, None] * m + np.arange(m)).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(np.rint(out[at].ravel() * UNIT).astype(np.int64))],
                names=["cell", "units"])

        sums = (rows.mapInArrow(run, "cell long, units long").groupBy("cell")
                .agg(F.sum("units").alias("units")).toArrow())  # at most ``n * m`` rows
        out = np.zeros(n * m)
        out[sums["cell"].to_numpy()] = sums["units"].to_numpy() / UNIT
        return out.reshape(n, m)

    def middle(raw: Callable, k: int, n: int) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(raw(_arrays(batch)[0]))], names=["raw"])

        ranked = rank_ranged(rows.mapInArrow(run, "raw double"), [("raw", False)], "at")
        low, high = ranked.agg(F.max(F.when(F.col("at") <= k, F.col("raw"))),
                               F.max(F.when(F.col("at") <= min(k + 1, n), F.col("raw")))).first()
        return (low + high) / 2

    return _fit(total, middle, statistics([b""]).shape[1], steps, decay)


def quality(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """Scores of all ``docs``, learnt from the rows of ``labels`` (doc_id,
    quality) that are not held out: (doc_id, held_out, score, predicted)."""
    every = stored(features(docs), "quality-features")
    chosen = labelled(labels, "quality", mod, held, train=True).toDF("id", "label")
    # of several texts of an id the one with the smallest features
    rows = (every.join(chosen, "id").groupBy("id", "label").agg(F.min("x").alias("x"))
            .sortWithinPartitions("id").select("label", "x"))
    rows = stored(rows, "quality-labelled")
    model = bradley_terry_rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            value = model.score(x.astype(float)) if model else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod
    return (every.mapInArrow(run, "doc_id long, score double, predicted int")
            .withColumn("held_out", fold == held)
            .select("doc_id", "held_out", "score", "predicted"))
