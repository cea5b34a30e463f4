"""Toxicity from nearest labelled examples (operator 8).

``fit`` takes a bounded sample of labelled documents as examples; the terms are
all their words, and ``Index`` keeps the examples' TF-IDF unit vectors over them as a
block-max inverted index: examples alike in their
commonest terms stand side by side, and each block of ``BLOCK`` examples keeps
every common term's greatest weight in it.

A document's exact k nearest examples by cosine come from all its terms, in double
precision.  The lists of its rarer terms are added up in full.  The k-th best of those sums is a first threshold;
the blocks of the best ones raise it.  The common terms' lists, which hold most of all
postings, are read only in blocks whose bound (the best sum in the block plus the
document's weights times the block's maxima, or times the block's longest vector of common terms, if
less) reaches the threshold; all other blocks are skipped.

A neighbour votes with its cosine to the fourth (so copies count most) plus three
times the part of its cosine that lies in the terms that go with the label by
chi-square.  Votes are calibrated by a logistic curve fitted on the examples
themselves, each scored without itself.

Document frequencies (for the idf) cover all documents; only the examples are
a sample: the first labelled documents by hash, at most ``max_examples`` and (but for the first)
``max_bytes`` of text in all, the bounds below.  A document's words that no example
holds have no number and are not in its length.

Defined cases: null or empty text, or one without any term of the examples, gets
the score of the examples without any; equal similarities go to the smaller
example number; repeated rows give repeated results; examples of equal text
count once, as the one with the smallest id; without labelled examples
every score is 0; only the id and text columns (and labels' id and label) are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import chunks, give_back, giving_back, labelled, ragged, stored, text_bytes
from mercato.llm.decontaminate import _word_array, spaced_words
from mercato.llm.linededup import text_hash

#: Labelled documents used as examples, at most, and bytes of their texts; the
#: chi-square a term needs to weight votes, and the weight.
MAX_EXAMPLES, MAX_BYTES, MIN_CHI2, TELLING = 6_000, 64 << 20, 15.0, 3.0
#: Examples of a block; terms whose lists are read by block (those most examples
#: hold); what rounding may take from a bound.
BLOCK, COMMON, SLACK = 16, 64, 1e-9
NEIGHBOURS = 15


def _doc_terms(texts: list[bytes], vocabulary: pa.Array | None):
    """(document, term, times) triples of some texts, sorted, and the vocabulary: the
    given one, or the words of these texts."""
    spaced = [spaced_words(t) for t in texts]
    n = np.array([s.count(b" ") for s in spaced], np.int64)
    coded = _word_array(b"".join(spaced)).dictionary_encode()
    words = pc.binary_slice(coded.dictionary, 0, -1).cast(pa.string())
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    if vocabulary is None:
        vocabulary, term = words, word
    else:
        number = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        term = number[word].astype(np.int64)
        doc, term = doc[term >= 0], term[term >= 0]
    width = max(1, len(vocabulary))
    pairs, times = np.unique(doc * width + term, return_counts=True)
    return pairs // width, pairs % width, times, vocabulary


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"),
                       text_hash(F.col(text_col).cast("string")).alias("text_hash"))


def examples_of(docs: DataFrame, labels: DataFrame, limit: int, max_bytes: int) -> DataFrame:
    """(id, text, label): the first labelled documents by a hash of their ids,
    distinct by text, at most ``limit`` and ``max_bytes``."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toDF("id", "label")
    # at most ``limit`` rows
    found = docs.join(F.broadcast(chosen), "id").where("text IS NOT NULL")
    first = found.groupBy("text").agg(F.min(F.struct("id", "label")).alias("one"))
    found = stored(first.select("one.id", "text", "one.label", F.xxhash64("one.id").alias("turn"),
                                F.octet_length("text").alias("bytes")), "toxicity-examples")
    sizes = found.select("turn", "bytes").toArrow().sort_by("turn")
    total = np.cumsum(sizes["bytes"].to_numpy().astype(np.int64))
    within = max(1, int(np.searchsorted(total, max_bytes, "right")))
    if within < len(total):
        found = found.where(F.col("turn") <= int(sizes["turn"][within - 1].as_py()))
    return found.select("id", "text", "label")


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(
            compression="zstd")) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def term_counts(examples: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All terms of the examples, sorted; how many hold each, and how many of
    those are toxic."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(0))
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in chunks([len(t) for t in texts]):
                doc, term, _, names = _doc_terms(texts[a:b], None)
                every = np.bincount(term, minlength=len(names))
                toxic = np.bincount(term, label[a:b][doc], len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(every.astype(np.int64)), pa.array(toxic)],
                    names=["term", "n", "n1"])

    # at most the terms of ``max_examples`` texts
    counts = (examples.select("text", "label").mapInArrow(run, "term string, n long, n1 long")
              .groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
              .toArrow().sort_by("term"))
    terms = counts["term"].combine_chunks()
    return (terms, *(counts[c].to_numpy().astype(float) for c in ("n", "n1")))


def telling(n: np.ndarray, n1: np.ndarray, total: int, ones: float, min_chi2: float) -> np.ndarray:
    """Whether a term's presence goes with the label, by chi-square."""
    if not 0 < ones < total:
        return np.zeros(len(n), bool)
    share = ones / total
    chi2 = (n1 - n * share) ** 2 / (n * share * (1 - share) * np.maximum(1 - n / total, 1 / total))
    return (n >= 3) & (n1 > 0) & (chi2 >= min_chi2)


def document_counts(docs: DataFrame, terms, n_terms: int) -> np.ndarray:
    """How many of the documents (id, text) hold each of the broadcast terms."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = terms.value.terms
        every = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in chunks([len(t) for t in texts]):
                every += np.bincount(_doc_terms(texts[a:b], vocabulary)[1], minlength=len(every))
        held = np.flatnonzero(every)
        for a in range(0, len(held), 1 << 16):
            at = held[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(every[at])],
                                             names=["t", "n"])

    # at most the terms of the examples
    found = docs.mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    often = np.ones(n_terms)
    often[found["t"].to_numpy()] = found["n"].to_numpy()
    return often


def example_terms(examples: DataFrame, terms) -> DataFrame:
    """(id, label, terms array<int>, times array<int>) of each example."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for a, b in chunks([len(t) for t in texts]):
                doc, term, times, _ = _doc_terms(texts[a:b], terms.value.terms)
                at = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.ListArray.from_arrays(at, pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))],
                    names=["id", "label", "terms", "times"])

    return examples.select("id", "label", "text").mapInArrow(
        run, "id long, label int, terms array<int>, times array<int>")


class Index:
    """The examples' unit vectors, by example, by rare term, and by block of
    examples for the common terms.

    ``at``, ``term``, ``weight`` hold the vectors one after another (terms ascending)."""

    def __init__(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int,
                 block: int = BLOCK, common: int = COMMON):
        self.n, self.n_terms, self.block = len(at) - 1, n_terms, block
        example = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(at))
        held = np.bincount(term, minlength=n_terms)
        top = np.sort(np.argsort(-held, kind="stable")[:common])
        top = top[held[top] > 0]
        self.column = np.full(n_terms, -1, np.int16)
        self.column[top] = np.arange(len(top))
        column = self.column[term]
        blocks = -(-self.n // block)
        # of the common terms: every weight by place, each block's maxima and longest part
        often = np.zeros((blocks * block, len(top)))
        frequent = column >= 0
        order = self._alike(example[frequent], column[frequent], weight[frequent], len(top))
        #: example at each place, and place of each example
        self.example = np.full(blocks * block, -1, np.int32)
        self.example[:self.n] = order
        self.place = np.empty(self.n, np.int32)
        self.place[order] = np.arange(self.n, dtype=np.int32)
        often[self.place[example[frequent]], column[frequent]] = weight[frequent]
        self.often = often.reshape(blocks, block, len(top))
        self.most = self.often.max(1, initial=0)
        self.longest = np.sqrt((self.often ** 2).sum(2)).max(1, initial=0)
        rare = np.flatnonzero(~frequent)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.list_place = self.place[example[rare]]
        self.list_weight = weight[rare]
        self.start = np.searchsorted(term[rare], np.arange(n_terms + 1)).astype(np.int64)
        #: blocks whose common lists were read, and those skipped
        self.read = self.skipped = 0

    def _alike(self, example, column, weight, columns: int) -> np.ndarray:
        """An order of the examples by their weightiest common term, then their second."""
        order = np.lexsort([-weight, example])
        rank = np.arange(len(order)) - np.searchsorted(example[order], example[order])
        key = np.full((2, self.n), columns)
        for k in (0, 1):
            own = order[rank == k]
            key[k, example[own]] = column[own]
        return np.lexsort([key[1], key[0]])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int,
                skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k most similar examples with a positive
        cosine, ``skip`` left out; exact, ties to the smaller number."""
        n = self.start[terms + 1] - self.start[terms]
        at = ragged(self.start[terms], n)
        sums = np.bincount(self.list_place[at], np.repeat(weights, n) * self.list_weight[at],
                           self.often.shape[0] * self.block)
        if skip >= 0:
            sums[self.place[skip]] = -2  # below any bound
        sums = sums.reshape(-1, self.block)
        column = self.column[terms]
        common = column >= 0
        column, own = column[common], weights[common]
        dense = np.zeros(self.often.shape[2])
        dense[column] = own
        best = sums.max(1)
        bound = best + np.minimum(self.most @ dense, self.longest * math.sqrt(float(own @ own)))
        full = np.full(sums.shape, -2.0)

        def read(blocks: np.ndarray) -> None:
            full[blocks] = sums[blocks] + self.often[blocks] @ dense
            self.read += len(blocks)

        # first the blocks with the best sums, then all others that may matter
        few = max(1, min(k, len(best)))
        first = np.argpartition(-best, few - 1)[:few]
        read(first)
        least = max(self._kth(full[first], k), self._kth(sums, k))
        more = bound >= least - SLACK
        more[first] = False
        read(np.flatnonzero(more))
        self.skipped += len(best) - few - int(more.sum())
        least = self._kth(full, k)
        # every product is positive or none: no rounding makes a zero of a positive one
        place = np.flatnonzero(((full > 0) & (full >= least)).ravel())
        found, score = self.example[place], full.ravel()[place]
        order = np.lexsort([found, -score])[:k]
        return found[order], score[order]

    @staticmethod
    def _kth(values: np.ndarray, k: int) -> float:
        return float(np.partition(values, values.size - k, None)[values.size - k]) if values.size > k else 0.0


class Terms:
    """The sorted terms, small while they travel."""

    def __init__(self, terms: pa.Array):
        self.data = packed(pa.table({"term": terms}))

    @cached_property
    def terms(self) -> pa.Array:
        return unpacked(self.data)["term"].combine_chunks()


class Examples(Terms):
    """What a vote needs; the term lists of a bounded sample.  Each worker makes the
    index once, from ``own``: (id, label, terms, times) of each example."""

    def __init__(self, terms: Terms, own: pa.Table, idf: np.ndarray, telling: np.ndarray,
                 prior: float, k: int):
        self.data, self.own, self.idf, self.telling = terms.data, packed(own), idf, telling
        self.prior, self.k = prior, k
        self.label, self.ids = own["label"].to_numpy().astype(float), own["id"].to_numpy()

    @cached_property
    def index(self) -> Index:
        index = Index(*self.example_vectors(), len(self.idf))
        give_back()
        return index

    @cached_property
    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The examples' vectors cut to the telling terms."""
        at, term, weight = self.example_vectors()
        kept = self.telling[term]
        before = np.concatenate([[0], np.cumsum(kept)])
        told = before[at], term[kept], weight[kept]
        del at, term, weight, kept, before
        give_back()
        return told

    def example_vectors(self):
        own = unpacked(self.own)
        terms, times = own["terms"].combine_chunks(), own["times"].combine_chunks()
        return self.vectors(terms.offsets.to_numpy().astype(np.int64), terms.values.to_numpy(),
                            times.values.to_numpy())

    def vectors(self, at: np.ndarray, terms: np.ndarray, times: np.ndarray):
        """Unit vectors of documents whose terms start at ``at``; terms that say nothing go."""
        weight = (1 + np.log(times)) * self.idf[terms]
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        norm = np.sqrt(np.bincount(doc, weight * weight, len(at) - 1))
        kept = norm[doc] > 0
        return (np.searchsorted(doc[kept], np.arange(len(at))), terms[kept].astype(np.int32),
                weight[kept] / norm[doc[kept]])

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1):
        """(vote, examples, cosines) of a document's nearest examples."""
        found, sim = self.index.nearest(terms, weights, self.k, skip)
        at, term, weight = self.told
        n = at[found + 1] - at[found]
        rows = ragged(at[found], n)
        own = np.flatnonzero(self.telling[terms])
        where = np.searchsorted(terms[own], term[rows])
        same = np.append(terms[own], -1)[where] == term[rows]
        product = weight[rows][same] * weights[own][where[same]]
        w = TELLING * np.bincount(np.repeat(np.arange(len(found)), n)[same], product, len(found)) + sim ** 4
        return (float(w @ self.label[found]) + 0.1 * self.prior) / (float(w.sum()) + 0.1), found, sim


@dataclass
class Model:
    """The broadcast examples, and how their votes become scores."""

    examples: object
    bare: float
    curve: tuple[float, float]

    def calibrated(self, raw: float) -> float:
        a, b = self.curve
        logit = math.log((raw + 0.01) / (1.01 - raw))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * logit + b))))


def own_votes(spark, examples, n: int) -> np.ndarray:
    """The vote on each of the n examples by the others; -1 for one without terms."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            it = examples.value
            at, term, weight = it.example_vectors()
            full = [int(i) for i in batch.column(0).to_numpy() if at[i] < at[i + 1]]
            raw = [it.vote(term[at[i]:at[i + 1]], weight[at[i]:at[i + 1]], i)[0] for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(raw, pa.float64())],
                                             names=["place", "raw"])

    out = np.full(n, -1.0)
    # at most ``max_examples`` rows
    found = spark.range(0, n, 1, max(1, min(8, n // 64))).mapInArrow(
        run, "place long, raw double").toArrow()
    out[found["place"].to_numpy()] = found["raw"].to_numpy()
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a slightly regularised one-variable logistic curve (Newton)."""
    design, theta = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (p - y) + 0.1 * (theta - [1.0, 0.0])
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        theta = theta - np.linalg.solve(hess, grad)
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES,
        min_chi2: float = MIN_CHI2, k: int = NEIGHBOURS) -> tuple[Model, DataFrame]:
    """The model, and the (id, text) rows of all documents.  ``labels`` has
    (doc_id, label)."""
    rows = _rows(docs, id_col, text_col)
    examples = examples_of(rows, labels, max_examples, max_bytes)
    names, n, n1 = term_counts(examples)
    context, terms = docs.sparkSession.sparkContext, Terms(names)
    shared = context.broadcast(terms)
    own = example_terms(examples, shared).toArrow().sort_by("id")
    total = rows.count()
    idf = np.log((total + 1) / document_counts(rows, shared, len(names)))
    shared.destroy()
    label = own["label"].to_numpy().astype(float)
    prior = float(label.mean()) if len(label) else 0.0
    known = context.broadcast(Examples(
        terms, own, idf, telling(n, n1, len(label), label.sum(), min_chi2), prior, k))
    raw = own_votes(docs.sparkSession, known, len(label))
    bare = raw < 0
    model = Model(known, float((label[bare].sum() + prior) / (bare.sum() + 1)) if len(label) else 0.0,
                  (1.0, 0.0))
    if (~bare).any():
        model.curve = _logistic(np.log((raw[~bare] + 0.01) / (1.01 - raw[~bare])), label[~bare])
    return model, rows


def score(rows: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """(doc_id, text_hash, score, predicted, evidence) of (id, text, text_hash) rows;
    evidence holds the nearest examples: (doc_id, similarity, label)."""
    def scored(texts: list[bytes]) -> tuple[list[float], list[list[dict]]]:
        known = model.examples.value
        doc, term, times, _ = _doc_terms(texts, known.terms)
        at, term, weight = known.vectors(np.searchsorted(doc, np.arange(len(texts) + 1)), term, times)
        out, proof = [model.bare] * len(texts), [[] for _ in texts]
        for i in np.flatnonzero(np.diff(at)).tolist():
            a = slice(at[i], at[i + 1])
            raw, found, sim = known.vote(term[a], weight[a])
            out[i] = model.calibrated(raw)
            proof[i] = [{"doc_id": int(known.ids[j]), "similarity": float(s),
                         "label": int(known.label[j])} for j, s in zip(found[:evidence], sim)]
        return out, proof

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # each distinct text of a batch once
            coded = batch.column(1).cast(pa.binary()).fill_null(b"").dictionary_encode()
            texts = coded.dictionary.to_pylist()
            which = coded.indices.to_numpy(zero_copy_only=False)
            out, proof = [], []
            for a, b in chunks([len(t) for t in texts]):
                value, found = scored(texts[a:b])
                out += value
                proof += found
                give_back()
            value = np.array(out, float)[which]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(value), pa.array((value >= 0.5).astype(np.int32)),
                 pa.array([proof[i] for i in which], pa.list_(pa.struct([
                     ("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())])))],
                names=["doc_id", "text_hash", "score", "predicted", "evidence"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, score double, predicted int, "
                           "evidence array<struct<doc_id:long,similarity:double,label:int>>")


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0,
             **options) -> DataFrame:
    """Scores of all ``docs``, learnt from the rows of ``labels`` (doc_id,
    toxic) that are not held out: (doc_id, held_out, score, predicted, evidence, text_hash)."""
    model, rows = fit(docs, labelled(labels, "toxic", mod, held, train=True), **options)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod
    return (score(rows, model).withColumn("held_out", fold == held)
            .select("doc_id", "held_out", "score", "predicted", "evidence", "text_hash"))
