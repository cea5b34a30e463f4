import numpy as np
import pytest

from mercato.llm import whitening
from mercato.llm.queries import QUERIES


def whole(vectors):
    return np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors])


def expect(x, k):
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((np.sqrt(np.maximum(e, 0)) > whitening.RANK * np.sqrt(e[0])).sum()))
    far = (n * x.astype(object) - s.astype(object)) ** 2
    return [d if d < 2 ** 63 else None for d in far.sum(1)], c @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(rows, ids, vectors, k=32, tolerance=1e-8):
    x = whole(vectors)
    deviation, white, explained = expect(x, k)
    k = white.shape[1]
    assert len(rows) == len(x) * k
    got = {(r.vec_id, r.component): r for r in rows}
    for c in range(k):
        own = [got[i, c + 1] for i in ids]
        value = np.array([r.whitened for r in own])
        sign = 1 if value @ white[:, c] > 0 else -1
        assert np.abs(sign * value - white[:, c]).max() < tolerance
        assert {r.n for r in own} == {len(x)}
        assert [r.deviation for r in own] == deviation
        assert abs(own[0].explained / explained[c] - 1) < 1e-9 and len({r.explained for r in own}) == 1
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8


def test_whole_table(spark, sf_dir):
    table = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
             if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    rows = QUERIES["op12_whitening"](spark, sf_dir).collect()
    check(rows, [r.vec_id for r in table], [r.embedding for r in table])


def frame(spark, rows):
    data = [(i, None if v is None else [None if c is None else float(c) for c in v], 3, 4, 5.0, "w")
            for i, v in rows]
    return spark.createDataFrame(
        data, "vec_id long, embedding array<double>, n int, id int, v double, whitened string").repartition(5)


@pytest.mark.parametrize("spread", [1.0, 1e4])
def test_badly_conditioned_rows(spark, spread):
    rng = np.random.default_rng(3)
    scale = np.geomspace(1, spread, 12) * 40
    turn = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    vectors = rng.normal(size=(3_000, 12)) * scale @ turn
    rows = whitening.whiten(frame(spark, list(enumerate(vectors))), components=12).collect()
    check(rows, list(range(3_000)), vectors, 12, 1e-6)


def test_dependent_parts_have_no_component(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-400, 400, size=(500, 3))
    vectors = np.stack([a[:, 0], a[:, 1], a[:, 0] + a[:, 1], np.full(500, 7), a[:, 2]], 1) / 64
    rows = whitening.whiten(frame(spark, list(enumerate(vectors)))).collect()
    assert {r.component for r in rows} == {1, 2, 3}
    check(rows, list(range(500)), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=4)) for i in range(50)]
    bad = [(90, None), (91, []), (92, [1, None, 2, 3]), (93, [1, float("nan"), 2, 3]),
           (94, [1, float("inf"), 2, 3]), (95, [1.0, 2.0]), (96, [1e300, 0, 0, 0])]
    rows = whitening.whiten(frame(spark, good + bad)).collect()
    check(rows, [i for i, _ in good], [v for _, v in good])
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1, 2]), (2, [1, 2])])).collect() == []
    # repeated and null ids are rows of their own
    rows = whitening.whiten(frame(spark, good + [(None, good[0][1]), good[1]])).collect()
    assert len(rows) == 52 * 4 and sum(r.vec_id is None for r in rows) == 4


def test_long_sums_and_deviations():
    rng = np.random.default_rng(6)
    x = rng.integers(-2 ** 45, 2 ** 45, size=(200, 3))
    sums = whitening.Sums(200, [int(s) for s in x.astype(object).sum(0)])
    exact = [sum((200 * int(c) - s) ** 2 for c, s in zip(r, sums.total)) for r in x]
    assert sums.deviations(x) == [e if e < 2 ** 63 else None for e in exact]
    small = x // 2 ** 30
    sums = whitening.Sums(200, [int(s) for s in small.sum(0)])
    assert sums.deviations(small) == [sum((200 * int(c) - s) ** 2 for c, s in zip(r, sums.total)) for r in small]
