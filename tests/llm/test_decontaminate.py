import hashlib
import re

from mercato.llm import decontaminate as dc
from mercato.llm.queries import QUERIES

UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - window + 1, min(len(w), 1))):
            wins.setdefault(tuple(w[k:k + window]), set()).add(item)
    sizes = {len(w) for w in wins}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[k:k + n]))):
                    hit |= set(range(k, k + n))
                    found |= own
        yield doc_id, len(w), len(hit), sorted(str(x) for x in found)


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = sorted((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0)
                  for d, n, h, i in plain(docs, items))
    got = sorted(tuple(r)[:6] for r in QUERIES["op2_decontaminate"](spark, sf_dir).collect())
    assert got == want and any(w[5] for w in want)


def test_odd_rows_blocks_and_segments(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "quick brown FOX jumps over the lazy dog again and again"), (1, "last"), (2, "one"),
         (3, None), (4, ""), (None, "one two"), (5, "éclair. über"), (11, "word5 alpha5 word6 alpha6"),
         (12, " ".join(f"word{i % 977} alpha{i % 13}" for i in range(5_000)))],
        "item_id long, text string")
    kept = [(r.item_id, r.text) for r in items.collect()]
    want = sorted(((-1 if d is None else d), n, h, tuple(i)) for d, n, h, i in plain(
        [(r.doc_id, r.text) for r in odd_docs.collect()], kept))
    for segment_words, block_words in ((1_000_000, 1_000_000), (50, 500)):
        found = dc.search(dc.build_index(odd_docs, segment_words=segment_words), items,
                          block_words=block_words)
        rows = found.withColumn("n_hit", dc.covered(found.phrases)).collect()
        got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_hit,
                      tuple(sorted({str(p["item"]) for p in r.phrases}))) for r in rows)
        assert got == want
    assert dc.contamination(no_docs, items).count() == 0
    assert dc.contamination(odd_docs, items.limit(0)).where("contaminated").count() == 0


def test_items_without_an_id_count_as_hits(make_docs, spark):
    docs = make_docs([(1, "a one two b", "s"), (2, "x y three", "s"), (3, "none", "s")])
    items = spark.createDataFrame([(None, "one two"), (None, "three"), (7, "three"), (7, "three")],
                                  "item_id long, text string")
    rows = {r.doc_id: r for r in dc.contamination(docs, items, near=4).collect()}
    assert [(rows[d].n_hit, rows[d].items, rows[d].near_items, rows[d].contaminated)
            for d in (1, 2, 3)] == [(2, [], [], True), (1, ["7"], [7], True), (0, [], [], False)]
    assert [tuple(p) for p in rows[2].phrases] == [(2, 1, 7), (2, 1, None)]


def test_equal_windows_are_looked_up_once_and_blocks_stay_out_of_plans(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(12))
    rows = dc.pa.table({"item": [1, 2, 3, None], "words": [dc.spaced_words(text.encode())] * 4})
    windows = dc.Windows(rows, 10)
    assert windows.word.shape == (3, 10) and len(windows.owner) == 12
    docs = make_docs([(1, f"x {text} y {text}", "s")])
    items = spark.createDataFrame([(i, text) for i in range(300)], "item_id long, text string")
    for block_words in (1_000_000, 50):
        row = dc.contamination(docs, items).first()
        assert (row.n_hit, len(row["items"]), row.n_words) == (24, 300, 26)
        found = dc.search(dc.build_index(docs), items, block_words=block_words).first()
        assert len(found.phrases) == 2 * 3 * 300


def test_proximity(spark, make_docs):
    docs = make_docs([(1, "alpha x x beta x gamma", "s"), (2, "gamma beta alpha", "s"),
                      (3, "alpha beta " + "x " * 50 + "gamma", "s"), (4, "alpha beta", "s"),
                      (5, "gamma", "s")])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = dc.search(dc.build_index(docs), items, near=5).collect()
    assert {r.doc_id for r in rows if r.near} == {1, 2}
    assert not any(r.phrases for r in rows)
    assert {r.doc_id for r in dc.search(dc.build_index(docs), items, near=60).collect()
            if r.near} == {1, 2, 3}
