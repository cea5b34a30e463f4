"""SimHash near-duplicates with vantage-point trees (operator 10).

``fingerprints`` gives every document a 64-bit SimHash of its word shingles.
``link`` finds all pairs of fingerprints that differ in at most
``max_distance`` bits and returns the connected components:

1. Equal fingerprints collapse to one node, so copies cost nothing later.
2. Of two fingerprints within d bits, the low or the high 32 bits are within
   d // 2 bits.  Each half has its own vantage-point tree, grown on a bounded
   sample: an inner node keeps a vantage point and a radius, near points go
   left, far ones right.  By the triangle bound only a near point at most
   d // 2 inside the radius can have a partner on the far side; it visits that
   shard too, so a close pair always meets in some leaf.
3. A leaf compares whole fingerprints, in shells by their distance to one more
   vantage point (shells further apart than d hold no pair), and returns
   a spanning forest, not all its pairs.  A leaf above ``leaf_rows`` is cut into
   blocks compared pairwise in separate tasks.
4. Components come from alternating large-star and small-star steps on the
   forest edges, each written to the shared folder.

Defined cases: a null or empty text has fingerprint zero and links like any
other; repeated rows give repeated result rows; a null id never becomes
a component id unless the whole component has none; only the id and text
columns are read, whatever else the input carries; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import chunks, discard, giving_back, ragged, stored, text_bytes
from mercato.llm.xxh import xxh64

#: Lower-cases A-Z of UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
#: Sampled fingerprints a tree is grown on, at most; leaves are added in
#: proportion to the input up to SAMPLE / PER_LEAF.
SAMPLE, PER_LEAF = 65_536, 16
#: Distinct fingerprints a leaf should hold, and the most one task compares.
LEAF_TARGET, LEAF_ROWS = 4_096, 32_768
HASH_BYTES = 256 << 10
_SPREAD = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def _pieces(text: bytes, shingle: int, limit: int) -> Iterator[bytes]:
    """A very long text in pieces of whole words; each repeats the last
    ``shingle - 1`` words of the one before, so no shingle is lost or doubled."""
    carry, start, done = [], 0, False
    while start < len(text):
        end = start + limit
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        carry += text[start:end].split()
        start = end
        if len(carry) >= shingle:
            yield b" ".join(carry)
            carry, done = carry[len(carry) - shingle + 1:], True
    if carry and not done:
        yield b" ".join(carry)


def _bit_counts(norms: list[bytes], shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each normalised text, and how often each hash bit is set."""
    buf = np.frombuffer(b"\n".join(norms) + b"\n", np.uint8)
    sep = np.flatnonzero((buf == 32) | (buf == 10))
    start = np.concatenate([[0], sep[:-1] + 1])
    last = buf[sep] == 10
    words = np.diff(np.concatenate([[-1], np.flatnonzero(last)]))
    empty = np.fromiter((not n for n in norms), bool, len(norms))
    first = np.cumsum(words) - words
    n = np.where(empty, 0, np.maximum(words - shingle + 1, 1))
    at = ragged(first, n)
    to = at + np.repeat(np.minimum(words, shingle) - 1, n)
    h = xxh64(buf, start[at], sep[to] - start[at], seed)
    bits = np.zeros((len(norms), 64), np.int64)
    if len(h):
        # runs of at most 255 shingles of one text, so that byte counters hold
        runs = -(-n // 255)
        owner = np.repeat(np.arange(len(n)), runs)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        run_start = (np.cumsum(n) - n)[owner] + 255 * nth
        octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for j in range(8):
            lanes = np.add.reduceat(_SPREAD[octets[:, j]], run_start)
            np.add.at(bits[:, 8 * j:8 * j + 8], owner,
                      lanes.astype("<u8").view(np.uint8).reshape(-1, 8))
    return n, bits


def simhash(texts: list[bytes], shingle: int = 3, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is 1 if set in over half the hashes
    of the shingles (repeats included)."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for a, b in chunks([len(t) for t in texts], HASH_BYTES):
        if b - a == 1 and len(texts[a]) > 16 * HASH_BYTES:
            n, bits = np.zeros(1, np.int64), np.zeros((1, 64), np.int64)
            for piece in _pieces(texts[a].translate(LOWER), shingle, 4 * HASH_BYTES):
                m, c = _bit_counts([piece], shingle, seed)
                n, bits = n + m, bits + c
        else:
            n, bits = _bit_counts([b" ".join(t.translate(LOWER).split()) for t in texts[a:b]],
                                  shingle, seed)
        out[a:b] = ((2 * bits > n[:, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3, seed: int = SEED) -> DataFrame:
    """(id, fp): the SimHash of each row's text as a signed long."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = simhash(text_bytes(batch.column(1)), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))],
                                             names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


class Tree:
    """A vantage-point tree over 32-bit halves, as arrays: children of node
    i are ``left[i]`` and ``right[i]``; ``leaf[i]`` is -1 at inner nodes."""

    def __init__(self, points: np.ndarray, per_leaf: int, rng: np.random.Generator):
        self.vantage, self.radius, self.left, self.right, self.leaf = [], [], [], [], []
        self.leaves = 0
        todo = [(self._node(), points)]
        while todo:
            node, own = todo.pop()
            split = self._split(own, rng) if len(own) > per_leaf else None
            if split is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            self.vantage[node], self.radius[node], near = split
            self.left[node], self.right[node] = self._node(), self._node()
            todo += [(self.left[node], own[near]), (self.right[node], own[~near])]
        self.vantage = np.array(self.vantage, np.uint32)
        self.radius, self.left, self.right, self.leaf = (
            np.array(x, np.int32) for x in (self.radius, self.left, self.right, self.leaf))

    def _node(self) -> int:
        for x in (self.vantage, self.radius, self.left, self.right):
            x.append(0)
        self.leaf.append(-1)
        return len(self.leaf) - 1

    @staticmethod
    def _split(own: np.ndarray, rng: np.random.Generator):
        """The vantage point, of a few tried, with an even split and few
        points on its boundary."""
        best = None
        for v in rng.choice(own, 8):
            d = np.bitwise_count(own ^ v).astype(np.int32)
            mid = int(np.median(d))
            for r in (mid - 1, mid):
                near = d <= r
                share = near.mean()
                cost = abs(share - 0.5) + (d == r).mean()
                if 0 < share < 1 and (best is None or cost < best[0]):
                    best = cost, (v, r, near)
        return best and best[1]

    def route(self, half: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(point index, leaf) of every shard each point visits: its own, and
        those across a boundary within ``reach`` (triangle bound)."""
        at, node = np.arange(len(half)), np.zeros(len(half), np.int32)
        points, leaves = [], []
        while len(at):
            end = self.leaf[node] >= 0
            points.append(at[end])
            leaves.append(self.leaf[node[end]])
            at, node = at[~end], node[~end]
            d = np.bitwise_count(half[at] ^ self.vantage[node]).astype(np.int32)
            near = d <= self.radius[node]
            over = near & (d > self.radius[node] - reach)
            at, node = (np.concatenate([at, at[over]]),
                        np.concatenate([np.where(near, self.left[node], self.right[node]),
                                        self.right[node[over]]]))
        return np.concatenate(points), np.concatenate(leaves)


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j in ``label`` (each points to its root)."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def forest(fp: np.ndarray, side: np.ndarray | None, max_distance: int) -> np.ndarray:
    """For sorted distinct fingerprints, the index of the smallest one each is
    linked with, directly or over others.  With ``side`` only pairs of
    different sides count."""
    label = np.arange(len(fp))
    if len(fp) < 2:
        return label
    d = np.bitwise_count(fp ^ fp[len(fp) // 2]).astype(np.int32)
    order = np.argsort(d, kind="stable")
    edge = np.searchsorted(d[order], np.arange(66 + max_distance))
    sorted_fp = fp[order]
    for s in range(65):
        a0, a1, b1 = edge[s], edge[s + 1], edge[s + 1 + max_distance]
        if a0 == a1:
            continue
        step = max(1, (1 << 20) // (b1 - a0))
        for k in range(a0, a1, step):
            x = sorted_fp[k:min(k + step, a1), None] ^ sorted_fp[None, k:b1]
            i, j = np.nonzero(np.bitwise_count(x) <= max_distance)
            up = i < j
            i, j = order[i[up] + k], order[j[up] + k]
            if side is not None:
                other = side[i] != side[j]
                i, j = i[other], j[other]
            _merge(label, i, j)
    return label


def _edges(nodes: DataFrame, n: int, max_distance: int, leaf_rows: int,
           leaf_target: int) -> DataFrame:
    """(a, b) with b < a: spanning forests of all links between distinct fingerprints."""
    reach = max_distance // 2
    want = int(min(max(n // leaf_target, 1), SAMPLE // PER_LEAF))
    sample = np.array([r.fp for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp")
                       .limit(min(SAMPLE, want * PER_LEAF)).collect()], np.int64).view(np.uint64)
    rng = np.random.default_rng(SEED)
    trees = [Tree((sample >> np.uint64(32 * k)).astype(np.uint32), PER_LEAF, rng) for k in (0, 1)]

    @giving_back
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            whole = fp.view(np.uint64)
            for k, tree in enumerate(trees):
                at, leaf = tree.route((whole >> np.uint64(32 * k)).astype(np.uint32), reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((leaf * 2 + k).astype(np.int32)), pa.array(fp[at])],
                    names=["leaf", "fp"])

    visits = stored(nodes.select("fp").mapInArrow(route, "leaf int, fp long"), "simhash-leaves")
    large = (visits.groupBy("leaf").count().where(F.col("count") > leaf_rows)
             .select("leaf", F.ceil(F.col("count") / (leaf_rows // 2)).cast("int").alias("blocks")))
    # at most one row for each leaf of the two trees
    cut = visits.join(F.broadcast(large), "leaf", "left")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tasks = (cut.withColumn("side", F.coalesce(block, F.lit(0)))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
             .select("leaf", F.least("side", "other").alias("i"),
                     F.greatest("side", "other").alias("j"), "side", "fp"))

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("fp").sort_values("fp")
        fp = group["fp"].to_numpy()
        label = forest(fp.view(np.uint64), None if key[1] == key[2] else group["side"].to_numpy(),
                       max_distance)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[linked], "b": fp[label[linked]]})

    return (tasks.groupBy("leaf", "i", "j").applyInPandas(compare, "a long, b long")
            .distinct())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b): every node ``a`` of the graph that is not the smallest of its
    component, with that smallest node ``b``.  ``edges`` has long columns a > b.

    Alternating large-star and small-star steps; each result is written to
    the shared folder, and the join side holding hubs is read from there, so
    adaptive execution can split them.
    """
    edges = stored(edges, name)
    while True:
        tall = edges.groupBy("a").count().where("count > 1").limit(1).count()
        chained = edges.select(F.col("b").alias("a")).join(edges, "a", "left_semi").limit(1).count()
        if not tall and not chained:
            return edges
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = stored(both.groupBy("u").agg(F.min("v").alias("m"))
                     .select("u", F.least("u", "m").alias("m")), name)
        large = stored(both.join(low, "u").where("v > u AND v != m")
                       .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), name)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = stored(large.join(least, "a").where("b != m").select(F.col("b").alias("a"), "m")
                       .union(least.select("a", "m")).toDF("a", "b").distinct(), name)
        for old in (edges, low, large, least):
            discard(old)
        edges = small


def link(prints: DataFrame, max_distance: int = 3, leaf_rows: int = LEAF_ROWS,
         leaf_target: int = LEAF_TARGET) -> DataFrame:
    """(id, fp) -> (id, fp, component): the smallest id reachable over links of
    at most ``max_distance`` bits."""
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    n = nodes.count()
    if not n:
        return prints.select("id", "fp", F.lit(None).cast("long").alias("component"))
    stars = components(_edges(nodes, n, max_distance, leaf_rows, leaf_target))
    roots = stored(nodes.join(stars, nodes.fp == stars.a, "left")
                   .select("fp", "low", F.coalesce("b", "fp").alias("root")), "simhash-roots")
    least = stored(roots.groupBy("root").agg(F.min("low").alias("component")), "simhash-least")
    named = stored(roots.join(least, "root").select("fp", "component"), "simhash-named")
    return prints.join(named, "fp", "left").select("id", "fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``;
    the fingerprint as 16 lower-case hex digits."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    linked = link(prints, max_distance)
    return linked.select(F.col("id").alias("doc_id"),
                         F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("component").alias("component_id"))
