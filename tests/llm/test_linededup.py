import hashlib

from mercato.llm import linededup as ld
from mercato.llm.queries import QUERIES

UPPER = {i: i + 32 for i in range(65, 91)}


def plain(docs, min_chars=10):
    lines = [(i, (t or "").split("\n")) for i, t in docs]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    owner = {}
    for i, own in lines:
        if i is not None:
            for x in own:
                if len(key(x)) >= min_chars:
                    owner[key(x)] = min(i, owner.get(key(x), i))
    for i, own in lines:
        kept = [x for x in own if i is None or owner.get(key(x), i) == i]
        yield i, len(own), len(own) - len(kept), "\n".join(kept)


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(docs))
    assert sorted(tuple(r) for r in QUERIES["op9_line_dedup"](spark, sf_dir).collect()) == want


def test_odd_rows(odd_docs, no_docs):
    want = sorted(map(str, plain([(r.doc_id, r.text) for r in odd_docs.collect()])))
    for batches, fan_in in ((1, 2), (3, 2), (5, 3)):
        got = ld.dedup_lines(odd_docs, batches=batches, fan_in=fan_in).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert ld.dedup_lines(no_docs).count() == 0


def test_batches_and_levels(spark, make_docs):
    """Batches added one by one give what one pass gives; runs stay few and sorted."""
    rows = [(i, "\n".join(f"shared line number {(i * 7 + k) % 23}" for k in range(5))
             + f"\nown line of document {i}\n" + "hot line of all documents", "s") for i in range(40)]
    want = {i: d for i, _, d, _ in plain([(i, t) for i, t, _ in rows])}
    store, dropped = ld.LineStore(spark, fan_in=2), {}
    for k in range(0, 40, 5):
        lines = ld.hashed_lines(make_docs(rows[k:k + 5]).selectExpr("doc_id AS id", "text"), 10)
        for r in store.add(lines).collect():
            dropped[r.id] = dropped.get(r.id, 0) + 1
        assert len(store.runs) <= 3
    assert dropped == {i: d for i, d in want.items() if d}
    assert [len(level) for level in store.levels] == [0, 0, 0, 1]
    hashes = [(r.h1, r.h2) for r in store.runs[0].collect()]
    assert len(hashes) == len(set(hashes)) == 23 + 40 + 1


def test_no_python_in_plans(odd_docs):
    plan = ld.dedup_lines(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
