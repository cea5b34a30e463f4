import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from mercato.llm import simhash
from mercato.llm.queries import QUERIES
from mercato.llm.xxh import xxh64

UPPER = {i: i + 32 for i in range(65, 91)}


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or (
        [" ".join(words)] if words else [])
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(fp, distance=3):
    f = np.array(fp, np.uint64)
    label = np.arange(len(f))
    while True:
        new = np.array([label[np.bitwise_count(f ^ x) <= distance].min() for x in f])
        if (new == label).all():
            return label
        label = new


def test_xxh64_slices():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 256, 5_000).astype(np.uint8)
    length = np.concatenate([np.arange(0, 300), rng.integers(1, 40, 500)])
    start = rng.integers(0, len(buf) - 300, len(length))
    raw = buf.tobytes()
    want = [xxhash.xxh64_intdigest(raw[s:s + n], 42) for s, n in zip(start, length)]
    assert xxh64(buf, start, length).tolist() == want


def test_fingerprints_of_odd_texts(odd_docs):
    for row in simhash.near_duplicates(odd_docs).join(
            odd_docs.select(F.col("doc_id").alias("d"), "text").distinct(), F.expr("doc_id <=> d")
    ).where("doc_id IS NOT NULL AND doc_id != 11").collect():
        assert int(row.fingerprint, 16) == plain_fingerprint(row.text)


def test_long_text_in_pieces():
    text = " ".join(f"w{i * 7919 % 1009}" for i in range(1_200_000)).encode()
    assert len(text) > 16 * simhash.HASH_BYTES
    n = sum(m for m in [simhash._bit_counts([p], 3, 42)[0][0]
                        for p in simhash._pieces(text, 3, 1 << 20)])
    assert n == 1_200_000 - 2
    whole = simhash._bit_counts([text], 3, 42)[1]
    assert int(simhash.simhash([text])[0]) == sum(
        int(2 * c > n) << b for b, c in enumerate(whole[0]))
    assert list(simhash._pieces(b"  one   " + b" " * 5_000_000, 3, 1 << 20)) == [b"one"]


def test_components_of_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert got[1] == got[2] == got[3] == 1      # no words: fingerprint zero, linked
    assert got[6] == got[7] == 6 and got[4] == 4
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_are_complete(spark):
    """Clusters, chains and hubs of near fingerprints, in small leaves and blocks."""
    rng = np.random.default_rng(3)
    fp = [int(x) for x in rng.integers(0, 2 ** 63, 400)]
    for seed in fp[:20]:
        for _ in range(30):  # a chain of steps of up to 3 bits
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                seed ^= 1 << int(b)
            fp.append(seed)
    hub = fp[0]
    fp += [hub ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    signed = [x - 2 ** 64 if x >= 2 ** 63 else x for x in fp]
    prints = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    want = plain_components(fp)
    for leaf_rows, target in ((50, 16), (simhash.LEAF_ROWS, simhash.LEAF_TARGET)):
        got = {r.id: r.component for r in simhash.link(
            prints, 3, leaf_rows=leaf_rows, leaf_target=target).collect()}
        assert [got[i] for i in range(len(fp))] == want.tolist()


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    fp = [plain_fingerprint(d.text) for d in docs]
    label = plain_components(fp)
    got = {r.doc_id: r for r in QUERIES["op10_simhash"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, f, c in zip(docs, fp, label):
        assert (got[d.doc_id].fingerprint, got[d.doc_id].component_id) == (
            f"{f:016x}", docs[c].doc_id)
