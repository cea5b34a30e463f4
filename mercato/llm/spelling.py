"""Spelling variants by bidirectional FM-index search schemes (operator 13).

``vocabulary`` counts the words of whole texts (partial counts per task).
``build_shards`` range-partitions them twice, by the word and by the reversed word, and
cuts both orders into shards of at most ``shard_words`` words.  Each shard is
one file in the shared folder: the FM-indexes (Burrows-Wheeler transforms) of
its delimited words ``$w1$w2$...$`` read forwards and backwards, whose suffix-rank
intervals move together, so a pattern can be extended on either side.

Two words one edit apart share the first half of either one or its second half
exactly.  ``Shard.search`` matches a word's half from its middle outwards to the
delimiter, then extends across the other half, allowing one replaced, inserted or
deleted code point, up to the other delimiter.  Shards of the forward order hold
all words with a given beginning in neighbouring shards, those of the
reversed order all with a given ending; a word is looked up only in shards
whose range meets its half, however many those are.  A pair whose two halves could
both serve is kept by the first one only, so counts add up over shards.

``variant_groups`` gives each word its form (the most frequent near word, if at
least ``ratio`` times as frequent) and its root (the last of the chain of forms;
counts rise along it, so pointer doubling ends after a few joins).

Defined cases: null or empty text has no words; a null id is the empty text in the
hash; repeated rows count each; equal counts go to the smaller word in code-point order; words
of any length are indexed whole; no words give no rows; only the id and
text columns are read.  The driver sees one row for each shard.
"""

from __future__ import annotations

import bisect
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import file_system, ragged, shared_folder, stored

#: Words of a shard, words a task looks up, and those searched together; distinct
#: words a task holds while counting.
SHARD_WORDS, TASK_WORDS, TOGETHER, HELD = 65_536, 8_192, 2_048, 200_000
#: Least length and occurrences of a word; how much more frequent a form must be.
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many (by hash) loses a code point.
SLIP = 199

LOWER = {a: a + 32 for a in range(65, 91)}
END, DELIMITER = 0, 1  # symbols; letters follow
BLOCK = 64
LAST = chr(0x10FFFF)


def _lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(LOWER)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): the stored words of ``docs``."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)  # shorter runs give no word

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
            names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own: Counter = Counter()
                for word, n in Counter(runs.findall(text.as_py() or "")).items():
                    own[_lowered(word)] += n
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield counted(held)
                    held = Counter()
        if held:
            yield counted(held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts.where(F.col("n") >= min_count), "words")


def suffix_array(seq: np.ndarray, symbols: int) -> np.ndarray:
    """Order of the suffixes of ``seq``, whose last symbol is the only END: by the
    first few symbols packed in one number, then by doubled lengths."""
    n, bits = len(seq), max(1, int(symbols - 1).bit_length())
    done = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for t in range(done):
        key <<= bits
        key[:max(0, n - t)] |= seq[t:]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if int(rank.max()) == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:max(0, n - done)] = rank[done:] + 1
        key, done = rank * (n + 1) + after, done * 2


class Ranks:
    """How many symbols below a given one stand before a place of a Burrows-Wheeler transform."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        n = len(bwt)
        blocks = n // BLOCK + 1
        padded = np.full(blocks * BLOCK, 255, np.uint8)
        padded[:n] = bwt
        self.bwt, self.blocks = bwt, padded.reshape(blocks, BLOCK)
        cell = np.arange(n) // BLOCK * (symbols + 1) + bwt + 1
        each = np.bincount(cell, minlength=blocks * (symbols + 1)).reshape(blocks, symbols + 1)
        #: symbols below s in all blocks before b
        self.before = np.zeros((blocks + 1, symbols + 1), np.int32)
        self.before[1:] = np.cumsum(np.cumsum(each, 1, dtype=np.int32), 0, dtype=np.int32)
        self.first = self.before[-1].astype(np.int64)

    def below(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        b, rest = place // BLOCK, place % BLOCK
        own = (self.blocks[b] < symbol[:, None]) & (np.arange(BLOCK) < rest[:, None])
        return self.before[b, symbol] + own.sum(1)

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The place in suffix order after extending by a symbol."""
        b, rest = place // BLOCK, place % BLOCK
        own = (self.blocks[b] == symbol[:, None]) & (np.arange(BLOCK) < rest[:, None])
        return (self.first[symbol] + self.before[b, symbol + 1] - self.before[b, symbol]
                + own.sum(1))


class Shard:
    """The bidirectional index of some distinct words."""

    def __init__(self, words: list[str], counts: np.ndarray, letters: np.ndarray,
                 forward: np.ndarray, backward: np.ndarray, ends: np.ndarray):
        self.words, self.counts, self.letters, self.ends = words, counts, letters, ends
        symbols = len(letters) + 2
        self.forward, self.backward = Ranks(forward, symbols), Ranks(backward, symbols)

    @classmethod
    def of(cls, words: list[str], counts: np.ndarray) -> "Shard":
        points = _points("\n" + "\n".join(words) + "\n")
        letters = np.unique(points[points != 10])
        text = np.where(points == 10, DELIMITER, np.searchsorted(letters, points) + 2)
        symbols = len(letters) + 2
        if symbols > 254:
            raise ValueError("words of a shard may have 252 different letters at most")
        order, both = None, []
        for seq in (text, text[::-1]):
            seq = np.append(seq, END)
            order = suffix_array(seq, symbols)
            both.append(seq[order - 1].astype(np.uint8))
        # where the suffixes that begin with a delimiter start, in the reversed text
        starts = order[1:len(words) + 2]
        ends = len(words) - 1 - np.searchsorted(np.sort(starts), starts)
        return cls(words, counts, letters, *both, ends.astype(np.int32))

    def to_bytes(self) -> bytes:
        table = pa.table({
            "words": [self.words], "counts": [self.counts], "letters": [self.letters],
            "forward": [self.forward.bwt.tobytes()], "backward": [self.backward.bwt.tobytes()],
            "ends": [self.ends]})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())

    @classmethod
    def from_bytes(cls, data: bytes) -> "Shard":
        row = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()
        numbers = lambda c: row[c].chunk(0).flatten().to_numpy()
        text = lambda c: np.frombuffer(row[c][0].as_py(), np.uint8)
        return cls(row["words"][0].as_py(), numbers("counts"), numbers("letters"),
                   text("forward"), text("backward"), numbers("ends"))

    def _halves(self, codes, start, half):
        """Intervals in the backward index of ``$`` + first half of each word: the
        half is matched from its last symbol leftwards, both intervals together."""
        n = len(start)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.forward.bwt))
        back = np.zeros(n, np.int64)
        alive = np.arange(n)
        for k in range(int(half.max(initial=0)) + 1):
            alive = alive[half[alive] >= k]
            ends = half[alive] == k
            c = np.where(ends, DELIMITER, codes[start[alive] + np.maximum(half[alive] - 1 - k, 0)])
            known = c >= 0
            lo[alive[~known]] = hi[alive[~known]] = 0
            alive, c = alive[known], c[known]
            a, b = lo[alive], hi[alive]
            back[alive] += self.forward.below(c, b) - self.forward.below(c, a)
            lo[alive], hi[alive] = self.forward.step(c, a), self.forward.step(c, b)
            alive = alive[hi[alive] > lo[alive]]
        return back, back + np.maximum(hi - lo, 0)

    def _next(self, lo, hi):
        """All extensions by one letter: (which interval, symbol, its interval)."""
        ranks, symbols = self.backward, len(self.letters) + 2
        width = hi - lo
        wide = np.flatnonzero(width > symbols)
        thin = np.flatnonzero(width <= symbols)
        key = np.repeat(thin, width[thin]) * symbols + ranks.bwt[ragged(lo[thin], width[thin])]
        key, times = np.unique(key, return_counts=True)
        owner, c = key // symbols, key % symbols
        letter = c > DELIMITER
        owner, c, times = owner[letter], c[letter], times[letter]
        a = ranks.step(c, lo[owner])
        b = a + times
        if len(wide):
            every = np.arange(2, symbols)
            owner2, c2 = np.repeat(wide, len(every)), np.tile(every, len(wide))
            a2, b2 = ranks.step(c2, lo[owner2]), ranks.step(c2, hi[owner2])
            some = b2 > a2
            owner, c = np.append(owner, owner2[some]), np.append(c, c2[some])
            a, b = np.append(a, a2[some]), np.append(b, b2[some])
        return owner, c, a, b

    def search(self, queries: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of the words that differ from a query by one edit
        behind its first ``halves`` code points; each pair once."""
        if not queries or not self.words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        length = np.array([len(q) for q in queries])
        start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        points = _points("\n".join(queries) + "\n")
        at = np.searchsorted(self.letters, points)
        codes = np.where(np.append(self.letters, 0)[at] == points, at + 2, -1)
        codes[points == 10] = DELIMITER  # a query ends in one
        lo, hi = self._halves(codes, start, halves)
        query = np.flatnonzero(hi > lo)
        lo, hi, place = lo[query], hi[query], halves[query].copy()
        empty = np.empty(0, np.int64)
        # intervals with one edit behind them: (query, next place, interval)
        pool = (empty, empty, empty, empty)
        found_query, found_word = [], []
        while len(query) or len(pool[0]):
            new = [pool]
            if len(query):
                owner, c, a, b = self._next(lo, hi)
                own, inside = codes[start[query] + place], place < length[query]
                other = c != own[owner]
                # of equal letters in a row, the edit is at the last
                new.append((query[owner[other]], place[owner[other]], a[other], b[other]))  # inserted
                last = np.flatnonzero(inside)
                last = last[own[last] != codes[start[query[last]] + place[last] + 1]]
                new.append((query[last], place[last] + 1, lo[last], hi[last]))  # deleted
                change = inside[owner] & other
                new.append((query[owner[change]], place[owner[change]] + 1, a[change], b[change]))
                go = inside[owner] & ~other
                query, place, lo, hi = query[owner[go]], place[owner[go]] + 1, a[go], b[go]
            q, p, a, b = (np.concatenate(x) for x in zip(*new))
            c = codes[start[q] + p]
            q, p, a, b, c = (x[c >= 0] for x in (q, p, a, b, c))
            a, b = self.backward.step(c, a), self.backward.step(c, b)
            some = b > a
            q, p, a, b, c = (x[some] for x in (q, p, a, b, c))
            over = c == DELIMITER
            found_query.append(np.repeat(q[over], (b - a)[over]))
            found_word.append(self.ends[ragged(a[over] - 1, (b - a)[over])])
            pool = tuple(x[~over] for x in (q, p + 1, a, b))
        key = np.unique(np.concatenate(found_query) * len(self.words) + np.concatenate(found_word))
        return key // len(self.words), key % len(self.words)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


def build_shards(words: DataFrame, reverse: bool, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Index files of (word, n) rows: one stored row (path, first, last) for each."""
    spark = words.sparkSession
    folder = shared_folder(spark, "spelling-index")
    key = F.reverse("word") if reverse else F.col("word")

    def write(words: list[str], counts: list[int]) -> tuple[str, str, str]:
        fs, at = file_system(folder)
        name = f"shard-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{at}/{name}") as out:
            out.write(Shard.of(words, np.array(counts, np.int64)).to_bytes())
        return f"{folder}/{name}", words[0], words[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, rows = [], [], []
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.append(word)
                counts.append(n)
                if len(words) == shard_words:
                    rows.append(write(words, counts))
                    words, counts = [], []
        if words:
            rows.append(write(words, counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string()) for i in range(3)],
            names=["path", "first", "last"])

    parts = max(1, -(-words.count() // shard_words))
    ordered = (words.select(key.alias("key"), "n").repartitionByRange(parts, "key")
               .sortWithinPartitions("key"))
    return stored(ordered.mapInArrow(run, "path string, first string, last string"), "shards")


def half_length(word: str, reverse: bool) -> int:
    """Code points of the half that must match: the first half forwards, the second backwards."""
    return len(word) - len(word) // 2 if reverse else len(word) // 2


def lookups(words: DataFrame, shards: DataFrame, reverse: bool) -> DataFrame:
    """(path, word, n): each word with each shard whose range meets its half."""
    ranges = sorted((r.first, r.last, r.path) for r in shards.collect())  # one row a shard
    first, last, path = [list(c) for c in zip(*ranges)] if ranges else ([], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, where = [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                key = word[::-1] if reverse else word
                half = key[:half_length(word, reverse)]
                for k in range(bisect.bisect_left(last, half), bisect.bisect_right(first, half + LAST)):
                    which.append(i)
                    where.append(path[k])
            at = pa.array(which, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.string()), batch.column(0).take(at), batch.column(1).take(at)],
                names=["path", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "path string, word string, n long")


def near_words(asked: DataFrame, reverse: bool) -> DataFrame:
    """(word, n_near, best_n, best) for each lookup: how many near words the shard
    holds, and the most frequent of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            paths, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for path in dict.fromkeys(paths):
                if path != at:
                    fs, name = file_system(path)
                    with fs.open_input_stream(name) as source:
                        shard, at = Shard.from_bytes(source.read()), path
                mine = sorted((w for w, p in zip(words, paths) if p == path), key=len)
                for k in range(0, len(mine), TOGETHER):
                    yield answers(shard, mine[k:k + TOGETHER], reverse)

    return asked.mapInArrow(run, "word string, n_near long, best_n long, best string")


def answers(shard: Shard, words: list[str], reverse: bool) -> pa.RecordBatch:
    halves = np.array([half_length(w, reverse) for w in words])
    query, found = shard.search([w[::-1] for w in words] if reverse else words, halves)
    near = np.zeros(len(words), np.int64)
    best: list[tuple[int, str]] = [(0, "")] * len(words)
    for i, j, n in zip(query.tolist(), found.tolist(), shard.counts[found].tolist()):
        word, other = words[i], shard.words[j]
        if reverse:
            other = other[::-1]
            if other.startswith(word[:len(word) // 2]):
                continue  # found forwards
        near[i] += 1
        best[i] = min(best[i], (-n, other))
    return pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array(near), pa.array([-b[0] for b in best], pa.int64()),
         pa.array([b[1] if b[0] else None for b in best], pa.string())],
        names=["word", "n_near", "best_n", "best"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows with a form: the end of each word's chain."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = stored(at.join(further, "root", "left")
                     .select("word", F.coalesce("beyond", "root").alias("root"),
                             F.col("beyond").isNotNull().alias("moved")), "roots")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   ratio: int = RATIO, shard_words: int = SHARD_WORDS, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``docs``."""
    words = vocabulary(docs, id_col, text_col, **options)
    tasks = max(1, -(-words.count() // TASK_WORDS))
    found = None
    for reverse in (False, True):
        asked = lookups(words, build_shards(words, reverse, shard_words), reverse)
        near = near_words(asked.repartitionByRange(tasks, "path", "word"), reverse)
        found = near if found is None else found.unionByName(near)
    best = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("top"))
    enough = -F.col("top.less") >= ratio * F.col("n")
    linked = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("top.best")).alias("form"),
        F.when(enough, -F.col("top.less")).alias("form_n")), "spelling-forms")
    chains = roots(linked.where("form IS NOT NULL"))
    return linked.join(chains, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
