import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mercato.llm import toxicity
from mercato.llm.queries import QUERIES


@pytest.mark.parametrize("folder,least_right,least_found", [(None, 0.9, 0.5), ("sf0.1", 0.97, 0.85)])
def test_held_out_accuracy(spark, sf_dir, folder, least_right, least_found):
    sf_dir = sf_dir if folder is None else f"/root/testdata/{folder}"
    rows = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, sf_dir).drop("evidence").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
              if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in rows]
    right = [rows[i].predicted == y for i, y in labels]
    assert np.mean(right) >= least_right
    found = [rows[i].predicted for i, y in labels if y]
    print(len(found), sum(found), len(right) - sum(right))
    assert np.mean(found) >= least_found


def flat(vectors):
    at = np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors])]).astype(np.int64)
    return (at, np.concatenate([t for t, _ in vectors]).astype(np.int32),
            np.concatenate([w for _, w in vectors]))


def made_vectors(n, n_terms, rng, groups=1):
    """Unit vectors with frequent first terms; each group has frequent terms of its own."""
    share = 1 / np.arange(1, n_terms // groups + 1) ** 0.7
    vectors = []
    for i in range(n):
        t = np.flatnonzero(rng.random(len(share)) < share) + i % groups * len(share)
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w) if len(t) else w))
    return vectors


@pytest.mark.parametrize("common", [0, 7, 64, 300])
@pytest.mark.parametrize("block", [1, 16, 500])
def test_search_is_exact(common, block):
    vectors = made_vectors(400, 300, np.random.default_rng(6))
    dense = np.zeros((400, 300))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.Index(*flat(vectors), 300, block=block, common=common)
    for i, (t, w) in enumerate(vectors):
        got, cos = index.nearest(t, w, 5, i)
        sim = dense @ dense[i]
        sim[i] = -1
        assert i not in got and np.allclose(cos, np.sort(sim)[::-1][:len(cos)])
        assert np.allclose(sim[got], cos) and len(cos) == min(5, (sim > 0).sum())
    got, cos = index.nearest(*vectors[3], 900)
    assert len(got) == (dense @ dense[3] > 0).sum()


def test_blocks_out_of_reach_are_skipped():
    vectors = made_vectors(2_000, 600, np.random.default_rng(7), groups=4)
    index = toxicity.Index(*flat(vectors), 600)
    for t, w in vectors[:100]:
        index.nearest(t, w, 15)
    assert index.read + index.skipped == 100 * 125
    assert index.skipped > index.read > 0  # three groups share no term with the fourth


def test_whole_table_against_brute_force(spark, sf_dir):
    """Neighbours, cosines and scores of every document, from word counts alone."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
             if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    counts = {i: Counter(word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)))
              for i, t in texts.items()}
    first = {}
    for i in sorted(label):
        first.setdefault(texts[i], i)
    own = sorted(first.values())
    vocabulary = {w: k for k, w in enumerate(sorted({w for i in own for w in counts[i]}))}
    held = np.zeros(len(vocabulary))
    for c in counts.values():
        held[[vocabulary[w] for w in c if w in vocabulary]] += 1
    idf = np.log((len(texts) + 1) / held)

    def vector(i):
        v = np.zeros(len(vocabulary))
        for w, n in counts[i].items():
            if w in vocabulary:
                v[vocabulary[w]] = (1 + np.log(n)) * idf[vocabulary[w]]
        return v / (np.linalg.norm(v) or 1)

    examples = np.stack([vector(i) for i in own])
    y = np.array([label[i] for i in own], float)
    present = examples > 0
    n, n1 = present.sum(0).astype(float), present[y == 1].sum(0).astype(float)
    share = y.mean()
    chi2 = (n1 - n * share) ** 2 / (n * share * (1 - share) * np.maximum(1 - n / len(y), 1 / len(y)))
    telling = (n >= 3) & (n1 > 0) & (chi2 >= toxicity.MIN_CHI2)

    def vote(v, skip=None):
        sim = examples @ v
        if skip is not None:
            sim[skip] = -1
        near = np.lexsort([np.arange(len(own)), -np.round(sim, 13)])[:toxicity.NEIGHBOURS]
        near = near[sim[near] > 0]
        w = toxicity.TELLING * (examples[near][:, telling] @ v[telling]) + sim[near] ** 4
        return (w @ y[near] + 0.1 * share) / (w.sum() + 0.1), near, sim[near]

    raw = np.array([vote(v, k)[0] for k, v in enumerate(examples)])
    a, b = toxicity._logistic(np.log((raw + 0.01) / (1.01 - raw)), y)
    rows = QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert len(rows) == len(texts) > 900
    for r in rows:
        v = vector(r.doc_id)
        if not v.any():
            assert not r.evidence
            continue
        value, near, sim = vote(v)
        score = 1 / (1 + np.exp(-(a * np.log((value + 0.01) / (1.01 - value)) + b)))
        assert abs(r.score - score) < 1e-6
        assert np.allclose([e.similarity for e in r.evidence], sim[:3], atol=1e-9)
        if len(set(np.round(sim[:4], 9))) == len(sim[:4]):
            assert [e.doc_id for e in r.evidence] == [own[k] for k in near[:3]]


def test_examples_are_bounded(spark, make_docs):
    docs = make_docs([(i, f"text {i % 30} " + "pad " * 100, "s") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    rows = toxicity._rows(docs, "doc_id", "text")
    every = toxicity.examples_of(rows, labels, 1_000, 1 << 20)
    assert sorted(r.id for r in every.collect()) == list(range(30))  # equal texts once
    some = toxicity.examples_of(rows, labels, 1_000, 4_200).collect()
    assert 0 < sum(len(r.text) for r in some) <= 4_200 and len(some) == 10
    assert toxicity.examples_of(rows, labels, 1_000, 1).count() == 1
    assert toxicity.examples_of(rows, labels, 7, 1 << 20).count() <= 7


def test_odd_rows(spark, odd_docs, no_docs, make_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)],
                                   "doc_id long, toxic int")
    rows = toxicity.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    unlabelled = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.0}


def test_evidence_names_examples(spark, make_docs):
    docs = make_docs([(i, ("you awful rotten thing " if i % 4 == 1 else "a fine kind day ")
                       + f"filler{i} and more", "s") for i in range(80)])
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(80)],
                                   "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels, min_chi2=5.0).collect()
    for r in rows:
        assert r.predicted == (r.doc_id % 4 == 1)
        if r.predicted:
            assert r.evidence and all(e.label == 1 for e in r.evidence)


def test_copy_of_an_example_finds_it(spark, make_docs):
    """Whatever its words: the copies here hold no term that goes with the label."""
    rude = "you awful rotten thing"
    rows = [(i, f"{rude if i % 3 == 0 else 'a fine kind day'} filler{i}", "s") for i in range(60)]
    lone = {100 + i: f"lone{i}x strange{i}y tale{i}z" for i in range(6)}
    rows += [(i, t, "s") for i, t in lone.items()] + [(i + 100, t, "s") for i, t in lone.items()]
    labels = spark.createDataFrame(
        [(i, int(i % 3 == 0)) for i in range(60)] + [(i, i % 2) for i in lone],
        "doc_id long, toxic int")
    train = {i for i in lone if zlib.crc32(str(i).encode()) % 5}
    found = {r.doc_id: r for r in toxicity.toxicity(make_docs(rows), labels).collect()}
    assert {i % 2 for i in train} == {0, 1}
    for i in train:
        first = found[i + 100].evidence[0]
        assert (first.doc_id, first.label) == (i, i % 2) and abs(first.similarity - 1) < 1e-9
        assert found[i + 100].predicted == i % 2
