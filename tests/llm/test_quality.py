import zlib

import numpy as np

from mercato.llm import quality
from mercato.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op6_quality"](spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
            if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in rows]
    assert np.mean([rows[i].predicted == y for i, y in held]) >= 0.93
    good = [rows[i].score for i, y in held if y]
    bad = [rows[i].score for i, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95


def test_pairs_order_documents():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    label = (x @ [2, -1, 0, 0, 1] + rng.normal(0, 0.2, 400) > -0.5).astype(int)
    model = quality.bradley_terry(x, label)
    score = model.score(x)
    assert np.mean((score >= 0.5) == label) >= 0.95
    assert abs(np.mean(score < 0.5) - np.mean(label == 0)) < 0.01  # threshold by quantile
    assert quality.bradley_terry(x, np.ones(400, int)) is None


def test_every_pair_counts():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    label = (x @ [1, -1, 0.5, 0] + rng.normal(0, 1, 300) > 0).astype(int)
    model = quality.bradley_terry(x, label, decay=1e-2)
    z = (x - model.mean) / model.scale
    pairs = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, 4)
    wrong = 1 / (1 + np.exp(pairs @ model.weights))
    # the gradient of the loss over all pairs vanishes
    assert np.abs(1e-2 * model.weights - pairs.T @ wrong / len(pairs)).max() < 1e-4


def test_every_labelled_document_counts(spark):
    # more labelled documents than the 20 000 that a fit once took
    n = 30_000
    docs = spark.range(n).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('A!', int(id % 7) + 1) "
        "ELSE concat('some words ', repeat('ab ', int(id % 11))) END AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 > 0) AS quality")
    every = quality.features(docs).join(labels.withColumnRenamed("doc_id", "id"), "id")
    rows = every.selectExpr("quality AS label", "x")
    got = quality.bradley_terry_rows(rows)
    data = rows.toArrow()
    x = data["x"].combine_chunks().flatten().to_numpy().reshape(n, -1).astype(float)
    want = quality.bradley_terry(x, data["label"].to_numpy())
    assert np.allclose(got.mean, x.mean(0), atol=1e-6) and np.allclose(got.weights, want.weights, atol=1e-3)
    assert np.isclose(got.threshold, want.threshold, atol=1e-3)
    again = quality.bradley_terry_rows(rows.repartition(3).sortWithinPartitions("x", "label"))
    assert np.allclose(again.weights, got.weights, atol=1e-3)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, int(i > 5)) for i in range(12)] + [(None, 1), (3, None), (4, 0)],
                                   "doc_id long, quality int")
    rows = quality.quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(no_docs, labels).count() == 0
    assert {r.score for r in quality.quality(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_statistics():
    x = quality.statistics([b"", b"AB ab\n1!", "é é".encode()])
    half = x.shape[1] // 2
    assert not x[0].any()
    assert np.allclose(x[1][:6], [2 / 8, 2 / 8, 1 / 8, 1 / 8, 1 / 8, 0])
    assert np.allclose(x[1][half:] ** 2, x[1][:half], atol=1e-6)
    assert np.isclose(x[2][5], 4 / 5) and np.isclose(x[2][half - 6], 0.5)
