import numpy as np
import pytest

from mercato.llm import onebit
from mercato.llm.queries import QUERIES


def brute(ids, vectors, query_ids, k):
    out = {}
    for q in query_ids:
        v = vectors[ids.index(q)]
        near = sorted((float(np.sqrt(((np.array(w, float) - np.array(v, float)) ** 2).sum())), i)
                      for i, w in zip(ids, vectors) if i != q and len(w) == len(v))
        out[q] = near[:k]
    return out


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, near in want.items():
        own = sorted(got.get(q, []))
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in near})
        total += len(near)
    return hits / total


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in rows], [list(r.embedding) for r in rows]
    want = brute(ids, vectors, [i for i in ids if i % 100 == 0], 10)
    got = QUERIES["op5_one_bit_codes"](spark, sf_dir).collect()
    assert recall(got, want) >= 0.99
    exact = {(q, i): d for q, near in want.items() for d, i in near}
    for r in got:
        if (r.query_id, r.vec_id) in exact:
            assert abs(r.score - exact[r.query_id, r.vec_id]) < 1e-9


SCHEMA = "vec_id long, embedding array<float>, v int, id string, score string, rank int"


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    hot = [float(x) for x in rng.normal(size=8)]
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    data += [(1_000 + i, hot) for i in range(200)] + [(700, hot), (700, hot)]
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [None]), (904, [float("nan")] + [1.0] * 7),
           (905, [float("inf")] * 8), (None, [1.0] * 8), (800, [1.0, 2.0]), (801, [1.0, 2.5]), (800, None)]
    rows = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in data + odd], SCHEMA)
    got = onebit.search(rows, rows.where("vec_id % 100 = 0"), k=10).collect()
    assert {r.query_id for r in got} == {0, 100, 200, 700, 800, 1_000, 1_100}
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    # the whole group of equal vectors ties: smallest ids first, the query's own id left out
    assert by[700] == [(1_000 + i, 0.0) for i in range(10)]
    assert by[1_000] == [(700, 0.0), (700, 0.0)] + [(1_001 + i, 0.0) for i in range(8)]
    assert by[800] == [(801, 0.5)]
    clean = [(i, v) for i, v in data]
    want = brute([i for i, _ in clean], [np.float32(v) for _, v in clean], [0, 100, 200], 10)
    assert recall([r for r in got if r.query_id in want], want) >= 0.99
    assert onebit.search(rows.limit(0), rows.limit(0)).count() == 0
    assert onebit.search(rows, rows.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    x, q = rng.normal(size=(800, dim)), rng.normal(size=(20, dim))
    coder = onebit.Coder(x, 4, 0)
    near, words, norm, own = coder.encode(x)
    exact = ((q[:, None] - x[None]) ** 2).sum(2)
    for j in range(4):
        at = np.flatnonzero(near == j)
        low, high = onebit._bounds(coder, q, j, words[at], norm[at], own[at], 6, 3.0)
        inside = (low <= exact[:, at] + 1e-9) & (exact[:, at] <= high + 1e-9)
        assert inside.mean() >= 0.99


def test_queries_of_many_lengths(spark):
    rows = spark.createDataFrame([(i, [float(i + j) for j in range(3)]) for i in range(12)],
                                 "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(100 + n, [1.0] * n) for n in range(1, 71)],
                                    "vec_id long, embedding array<float>")
    got = onebit.search(rows, queries, k=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(103, 1, 0), (103, 2, 1)]
