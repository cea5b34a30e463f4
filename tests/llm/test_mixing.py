import itertools
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mercato.llm import mixing
from mercato.llm.queries import QUERIES


def plain_targets(size):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, out = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in out]
        rest = total - sum(out.values())
        over = [s for s in free
                if rest * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]
        if not over:
            return out | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        out |= {s: 3 * size[s] for s in over}


def check(docs, rows):
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((i, size_of(t)) for i, t, _ in docs) == Counter((r.doc_id, r["size"]) for r in rows)
    size = defaultdict(int)
    for _, t, s in docs:
        size[s] += size_of(t)
    target, by_size = plain_targets(size), defaultdict(list)
    for s in size:
        by_size[size[s], round(target[s], 3)].append(s)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size, round(r.target, 3)] += r.taken
    assert set(taken) == set(by_size)
    for (n, goal), names in by_size.items():
        assert abs(taken[n, goal] - goal * len(names)) <= len(names)


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source)
            for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op7_mixing"](spark, sf_dir).collect()
    check(docs, rows)
    again = QUERIES["op7_mixing"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_rows(odd_docs, no_docs, make_docs):
    check([(r.doc_id, r.text, r.source) for r in odd_docs.collect()],
          mixing.mix(odd_docs).collect())
    assert mixing.mix(no_docs).count() == 0
    empty = mixing.mix(make_docs([(1, None, "a"), (2, "", None)])).collect()
    assert [(r.taken, r.target) for r in empty] == [(0, 0.0)] * 2


def test_target_cap_is_shared_again(make_docs):
    docs = make_docs([(1, "w " * 10, "a"), (2, "w " * 10, "b"), (3, "w " * 1_000, "c"),
                      (4, "w " * 1_000, "d")])
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert got[1].target == 30 and got[1].taken == 30 and got[2].taken == 30
    assert got[3].target == 1470 and got[4].target == 490


def brute_cost(patterns, quotas, repeats):
    """Best (total, -cost) over all integer flows of a tiny problem."""
    edges = [(i, s) for i, (own, _) in enumerate(patterns) for s in own]
    best = (-1, 0)
    for flow in itertools.product(*(range(min(quotas[s], repeats * patterns[i][1]) + 1)
                                    for i, s in edges)):
        into, out = defaultdict(int), defaultdict(int)
        for (i, s), n in zip(edges, flow):
            into[s] += n
            out[i] += n
        if any(into[s] > quotas[s] for s in into) or any(
                out[i] > repeats * patterns[i][1] for i in out):
            continue
        cost = sum(max(0, n - k * patterns[i][1]) for i, n in out.items() for k in (1, 2))
        best = max(best, (sum(flow), -cost))
    return best


@pytest.mark.parametrize("patterns,quotas", [
    ([([0], 2), ([0, 1], 2), ([1], 1)], {0: 4, 1: 4}),
    ([([0, 1], 2), ([1, 2], 1), ([0], 1)], {0: 2, 1: 3, 2: 3}),
    ([([0, 1, 2], 2), ([2], 1)], {0: 1, 1: 1, 2: 5}),
    ([([0], 0), ([0, 1], 1)], {0: 3, 1: 1}),
])
def test_flow_is_cheapest(patterns, quotas):
    given = mixing.min_cost_flow(patterns, quotas, 3)
    out, into = defaultdict(int), defaultdict(int)
    for (i, s), n in given.items():
        assert n >= 0 and s in patterns[i][0]
        out[i] += n
        into[s] += n
    assert all(into[s] <= quotas[s] for s in into)
    cost = sum(max(0, n - k * patterns[i][1]) for i, n in out.items() for k in (1, 2))
    assert (sum(given.values()), -cost) == brute_cost(patterns, quotas, 3)


def test_overlapping_sources(make_docs):
    docs = make_docs([(i, "w " * (5 + i), ["a", "a,b", "b", "c", "b,c"][i % 5]) for i in range(60)])
    mixed = mixing.mix(docs, sources=F.split("source", ",")).collect()
    assert len(mixed) == 60 and all(0 <= r.taken <= 3 * r["size"] for r in mixed)
    total = sum(r["size"] for r in mixed)
    claimed = sum(r["size"] * len(r.sources) for r in mixed)
    assert total < claimed
    assert abs(sum(r.taken for r in mixed) - claimed) <= 3  # all quotas can be met
