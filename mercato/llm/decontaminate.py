"""Benchmark decontamination over a distributed positional index (operator 2).

``build_index`` turns documents into index segments, one row each, stored in
the shared folder: the segment's dictionary, and for every word the ascending
positions at which it occurs.  Segments are cut by documents, so no word, however frequent,
gathers in one place, and building needs no shuffle.

``search`` runs benchmark windows against every segment.  A window's position
lists are intersected from its rarest word on: candidate starts are that
word's positions less its offset, and each further word keeps the starts at
which it occurs at its own offset (exact phrases).  With ``near`` given, the
same order finds places where all words of a window lie within that many
words of the rarest (proximity).  Windows lie in the shared folder in blocks
of bounded size; a task reads one block at a time, the driver none.  Equal
windows of several items are looked up once.

Defined cases: null text has no words; a row without words gives n_words 0
and no match; repeated rows give repeated results; items without words have
no windows; windows of an item without an id are matched and count as hits
like others (``item`` is null there), only the lists of ids leave it out;
an item in several rows counts once in a document's items; only the id
and text columns are read.  A document is held whole by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import (discard, file_system, giving_back, ragged, shared_folder, stored,
                                text_bytes)

#: Lower-cases A-Z and turns every byte outside words into a space.  Words are
#: runs of 0-9, a-z and non-ASCII characters.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
                   else 32 for b in range(256))
#: Words a segment holds (or one document), and those one block of windows may have.
SEGMENT_WORDS, BLOCK_WORDS = 1_000_000, 1_000_000
#: Candidate positions looked at together.
CANDIDATES = 1 << 20
ITEM_WORDS = 4_096

SEGMENT = ("segment long, ids array<long>, n_words array<int>, words array<binary>, "
           "counts array<int>, postings binary")
MATCHES = ("segment long, ordinal int, doc_id long, n_words long, "
           "phrases array<struct<start:int,n:int,item:long>>, "
           "near array<struct<at:int,item:long>>")


def spaced_words(text: bytes) -> bytes:
    """The words of a text, each followed by one space."""
    words = text.translate(WORD_BYTES).split()
    return b" ".join(words) + b" " if words else b""


def _word_array(spaced: bytes) -> pa.Array:
    """Words (with their space) of a buffer of spaced words."""
    ends = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32).astype(np.int32) + 1
    offsets = np.concatenate([np.zeros(1, np.int32), ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(spaced)])


def _segment(number: int, ids: list[int | None], docs: list[bytes]) -> pa.RecordBatch:
    n_words = np.array([d.count(b" ") for d in docs], np.int32)
    coded = _word_array(b"".join(docs)).dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False)
    # positions leave one gap between documents: no phrase runs over it
    position = np.arange(len(word), dtype=np.int32) + np.repeat(
        np.arange(len(docs), dtype=np.int32), n_words)
    order = np.argsort(word, kind="stable")
    counts = np.bincount(word, minlength=len(coded.dictionary)).astype(np.int32)
    steps = np.diff(position[order], prepend=np.int32(0)).astype("<i4")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)
    blob = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), one(ids, pa.int64()), one(n_words, pa.int32()),
         pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), coded.dictionary),
         one(counts, pa.int32()), pa.array([blob], pa.binary())],
        names=["segment", "ids", "n_words", "words", "counts", "postings"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index of ``docs``: one row for each segment."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, total = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                spaced = spaced_words(text)
                ids.append(doc_id)
                held.append(spaced)
                total += len(spaced) // 6 + 1
                if total >= segment_words:
                    yield _segment(number, ids, held)
                    number, ids, held, total = number + 1, [], [], 0
        if ids:
            yield _segment(number, ids, held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, SEGMENT), "word-index")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
               window: int = 10) -> DataFrame:
    """(item, words, n): the spaced words of each item; long items in pieces
    that repeat ``window - 1`` words, so each window lies in one piece."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = text.translate(WORD_BYTES).split()
                step = max(1, ITEM_WORDS - window + 1)
                for k in range(0, max(len(words) - window + 1, min(len(words), 1)), step):
                    piece = words[k:k + step + window - 1]
                    out.append((item, b" ".join(piece) + b" ", len(piece)))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()),
                 pa.array(cols[2], pa.int64())], names=["item", "words", "n"])

    rows = items.select(F.col(id_col).cast("long").alias("item"),
                        F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, "item long, words binary, n long")


def window_blocks(items: DataFrame, window: int, id_col: str, text_col: str,
                  block_words: int) -> tuple[str, int]:
    """The distinct pieces of the items in a shared folder, one subfolder for each
    block of about ``block_words`` words; the folder and the number of blocks."""
    words = stored(item_words(items, id_col, text_col, window).distinct(), "item-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    folder = shared_folder(items.sparkSession, "window-blocks")
    (words.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
     .repartition(blocks, "block").write.mode("overwrite").partitionBy("block").parquet(folder))
    discard(words)
    return folder, blocks


def read_block(folder: str, block: int) -> pa.Table:
    """(item, words) of one block, inside a task."""
    system, root = file_system(folder)
    found = system.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True))
    parts = []
    for info in found:
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                parts.append(pq.ParquetFile(file).read(columns=["item", "words"]))
    return pa.concat_tables(parts) if parts else pa.table(
        {"item": pa.array([], pa.int64()), "words": pa.array([], pa.binary())})


class Windows:
    """The distinct windows of a block: ``terms`` (distinct words), a matrix of
    term numbers, one row for each window, padded with -1, and each window's
    distinct items."""

    def __init__(self, rows: pa.Table, window: int):
        pieces = rows.column("words").to_pylist()
        coded = _word_array(b"".join(pieces)).dictionary_encode()
        self.terms = coded.dictionary
        number = coded.indices.to_numpy(zero_copy_only=False)
        n = np.array([words.count(b" ") for words in pieces], np.int64)
        starts = np.maximum(n - window + 1, 1)
        first = ragged(np.cumsum(n) - n, starts)
        length = np.repeat(np.minimum(n, window), starts)
        at = first[:, None] + np.arange(window)
        inside = np.arange(window) < length[:, None]
        word = np.where(inside, number[np.where(inside, at, 0)] if len(number) else -1, -1)
        self.word, which = np.unique(word.astype(np.int32), axis=0, return_inverse=True)
        self.word = self.word.astype(np.int64)
        self.length = (self.word >= 0).sum(axis=1)
        item = rows.column("item").combine_chunks().dictionary_encode("encode")
        self.items = item.dictionary
        own = item.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kinds = max(len(self.items), 1)
        pairs = np.unique(which.reshape(-1).astype(np.int64) * kinds + np.repeat(own, starts))
        self.owner = pairs % kinds
        self.owner_at = np.searchsorted(pairs, np.arange(len(self.word) + 1) * kinds)

    def with_items(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(window, place) pairs once for each item of the window: windows, places, items."""
        window, place = found
        n = np.diff(self.owner_at)[window]
        owner = self.owner[ragged(self.owner_at[window], n)]
        return np.repeat(window, n), np.repeat(place, n), self.items.take(pa.array(owner))


class Segment:
    """A segment's lists as one ascending array of (word, position) keys."""

    def __init__(self, n_words: np.ndarray, words: pa.Array, counts: np.ndarray, blob: bytes):
        self.words, self.n_words = words, n_words
        self.counts = counts.astype(np.int64)
        self.at = np.cumsum(self.counts) - self.counts
        n = int(self.counts.sum())
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        steps = np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()
        self.position = np.cumsum(steps, dtype=np.int64)
        self.first = np.cumsum(n_words.astype(np.int64) + 1) - n_words - 1
        self.span = int(self.first[-1] + n_words[-1] + 1) if len(n_words) else 1
        self.keys = np.repeat(np.arange(len(counts), dtype=np.int64), self.counts) * self.span
        self.keys += self.position

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def any_between(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether ``word`` occurs at a position from low to high."""
        k = np.searchsorted(self.keys, word * self.span + low)
        return (k < len(self.keys)) & (
            self.keys[np.minimum(k, len(self.keys) - 1)] <= word * self.span + high)

    def find(self, windows: Windows, near: int | None):
        """Arrays of (window, start) of phrases and (window, position) of near matches."""
        own = pc.index_in(windows.terms, value_set=self.words).fill_null(-1).to_numpy(
            zero_copy_only=False).astype(np.int64)
        pad = windows.word < 0
        word = np.where(pad, -1, own[windows.word])
        live = np.flatnonzero(((word >= 0) | pad).all(axis=1) & (windows.length > 0))
        word = word[live]
        often = np.where(pad[live], np.iinfo(np.int64).max, self.counts[word])
        order = np.argsort(often, axis=1, kind="stable")
        rare = order[:, 0]
        rows = np.arange(len(live))
        lists = self.counts[word[rows, rare]]
        phrases, close = [], []
        a = 0
        while a < len(live):
            b = max(a + 1, int(np.searchsorted(np.cumsum(lists[a:]), CANDIDATES, "right")) + a)
            # a window of very frequent words only is looked at in several parts
            for part in range(0, int(lists[a:b].max()) if b == a + 1 else 1, CANDIDATES):
                n = np.minimum(lists[a:b] - part, CANDIDATES) if b == a + 1 else lists[a:b]
                row = np.repeat(rows[a:b], n)
                hit = self.position[ragged(self.at[word[rows[a:b], rare[a:b]]] + part, n)]
                phrases.append(self._phrases(windows, live, word, order, row, hit))
                if near is not None:
                    close.append(self._near(windows, live, word, order, row, hit, near))
            a = b
        none = np.empty((2, 0), np.int64)
        return (np.concatenate([none, *phrases], axis=1), np.concatenate([none, *close], axis=1))

    def _phrases(self, windows, live, word, order, row, hit):
        start = hit - order[row, 0]
        for j in range(1, word.shape[1]):
            offset = order[row, j]
            w = word[row, offset]
            ok = (w < 0) | self.any_between(np.maximum(w, 0), start + offset, start + offset)
            row, start = row[ok], start[ok]
        return np.stack([live[row], start])

    def _near(self, windows, live, word, order, row, hit, near):
        doc = self.doc_of(hit)
        low = np.maximum(hit - near, self.first[doc])
        high = np.minimum(hit + near, self.first[doc] + self.n_words[doc] - 1)
        for j in range(1, word.shape[1]):
            w = word[row, order[row, j]]
            ok = (w < 0) | self.any_between(np.maximum(w, 0), low, high)
            row, hit, low, high = row[ok], hit[ok], low[ok], high[ok]
        return np.stack([live[row], hit])


def _lists(doc: np.ndarray, n_docs: int, item: pa.Array, **fields: np.ndarray) -> pa.Array:
    """A list of structs for each document, in the order of the fields, then the item's."""
    missing = np.asarray(item.is_null())
    value = item.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort([value, missing, *list(fields.values())[::-1], doc])
    offsets = np.searchsorted(doc[order], np.arange(n_docs + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays(
        [pa.array(v[order], pa.int32()) for v in fields.values()]
        + [pa.array(value[order], pa.int64(), mask=missing[order])], names=[*fields, "item"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def search(index: DataFrame, items: DataFrame, window: int = 10, near: int | None = None,
           id_col: str = "item_id", text_col: str = "text",
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every indexed document with its matches: (segment, ordinal, doc_id,
    n_words, phrases, near).  ``phrases`` holds (start, n, item) for each
    occurrence of an item window, ``near`` (at, item) for proximity matches.

    Each segment is searched for one block of windows after another (at most
    about ``block_words`` words each), read from the shared folder."""
    folder, blocks = window_blocks(items, window, id_col, text_col, block_words)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows, turn = -1, None, range(blocks)
        for batch in batches:
            for k in range(batch.num_rows):
                number, ids, n_words, words, counts, blob = (batch.column(c)[k] for c in range(6))
                ids = ids.values
                n_words = n_words.values.to_numpy(zero_copy_only=False)
                seg = Segment(n_words, words.values, counts.values.to_numpy(zero_copy_only=False),
                              blob.as_py())
                phrases, close = [], []
                for b in turn:
                    if b != block:
                        block, windows = b, Windows(read_block(folder, b), window)
                    exact, around = seg.find(windows, near)
                    which, start, item = windows.with_items(exact)
                    phrases.append((start, windows.length[which], item))
                    _, at, item = windows.with_items(around)
                    close.append((at, item))
                turn = turn[::-1]  # the next segment begins with the block at hand
                start, n, item = (join(part) for join, part in zip(
                    (np.concatenate, np.concatenate, pa.concat_arrays), zip(*phrases)))
                doc = seg.doc_of(start)
                by_doc = _lists(doc, len(ids), item, start=start - seg.first[doc], n=n)
                at, item = (join(part) for join, part in zip(
                    (np.concatenate, pa.concat_arrays), zip(*close)))
                doc = seg.doc_of(at)
                near_by_doc = _lists(doc, len(ids), item, at=at - seg.first[doc])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), number.as_py())),
                     pa.array(np.arange(len(ids), dtype=np.int32)), ids,
                     pa.array(n_words.astype(np.int64)), by_doc, near_by_doc],
                    names=["segment", "ordinal", "doc_id", "n_words", "phrases", "near"])

    return index.mapInArrow(run, MATCHES)


def covered(phrases: Column) -> Column:
    """Words inside any of the phrases (sorted by start)."""
    zero = F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(phrases, zero, lambda a, p: F.struct(
        F.greatest(a["until"], p["start"] + p["n"]).alias("until"),
        (a["n"] + F.greatest(F.lit(0), p["start"] + p["n"] - F.greatest(a["until"], p["start"])))
        .alias("n")), lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10,
                  near: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit (words inside an
    occurrence of a window), items (ids with occurring windows, no null, sorted as
    strings), near_items, phrases, contaminated."""
    found = search(build_index(docs, id_col), items, window, near)
    known = lambda matches: F.filter(
        F.transform(matches, lambda m: m["item"]), lambda item: item.isNotNull())
    names = F.array_sort(F.array_distinct(F.transform(
        known("phrases"), lambda item: item.cast("string"))))
    return (found.withColumn("n_hit", covered(F.col("phrases"))).withColumn("items", names)
            .withColumn("near_items", F.array_distinct(known("near")))
            .select("doc_id", "n_words", "n_hit", "items", "near_items", "phrases",
                    (F.col("n_hit") > 0).alias("contaminated")))
