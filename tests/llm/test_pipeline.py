import inspect

import corpus_pipeline
from mercato.llm import decontaminate, mixing, simhash, tokens, toxicity
from mercato.llm.common import table
from mercato.llm.queries import tokenizer_path


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "token output"]
    for _, f in corpus_pipeline.STAGES:
        assert list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"]


def test_decisions_take_effect(spark, sf_dir):
    """Each stage against its operator's own decisions on the stage's input."""
    docs = table(spark, sf_dir, "documents")
    everything = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir).cache()
    bad = {r.doc_id for r in toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
           .where("predicted = 1").collect()}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(everything) - bad) and bad

    once = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir).cache()
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept).collect()}
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(groups.values()))
    assert once.count() < kept.count() and once.columns == docs.columns

    clean = corpus_pipeline.drop_contaminated(spark, once, sf_dir).cache()
    found = {r.doc_id: r.contaminated for r in
             decontaminate.contamination(once, table(spark, sf_dir, "benchmark")).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, c in found.items() if not c)
    assert clean.columns == docs.columns

    mixed = corpus_pipeline.mix_sources(spark, clean, sf_dir).cache()
    want = {r.doc_id: r.copies for r in mixing.copies(mixing.mix(clean)).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n} and mixed.columns == docs.columns
    assert all(r.text == everything[r.doc_id] for r in mixed.collect())

    out = corpus_pipeline.write_tokens(spark, mixed, sf_dir).collect()
    assert len(out) == mixed.count()
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_whole_run(spark, sf_dir):
    small = sf_dir.replace("sf0.01", "sf0.001")
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and len({r.start for r in rows}) == len(rows)


def test_stages_on_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, sf_dir)
        if name != "token output":
            assert out.columns == odd_docs.columns
        assert out.count() > 0
        assert stage(spark, no_docs, sf_dir).count() == 0
    once = corpus_pipeline.drop_near_duplicates(spark, odd_docs, sf_dir)
    ids = [r.doc_id for r in once.collect()]
    # a null id is an id like others: the empty text without one is a copy of document 1
    assert ids.count(None) == 1 and ids.count(7) == 0 and ids.count(6) == 1 and ids.count(1) == 1
    assert tokens.token_files(once, tokenizer_path()).count() == len(ids)


def test_decisions_hit_their_own_rows(spark, make_docs, tmp_path):
    """Repeated ids on different texts, and null ids: every row is judged by itself."""
    rude, kind = "you awful rotten thing", "a fine kind day"
    passage = " ".join(f"passage{k}" for k in range(12))
    lone = " ".join(f"lone{k}" for k in range(40))
    rows = [(i, f"{rude if i % 3 == 0 else kind} filler{i} more{i} tail{i}", "s") for i in range(60)]
    odd = [(500, f"{rude} again500", "s"), (500, f"{lone} clean500", "s"), (None, f"{rude} nobody", "s"),
           (None, f"{lone} x y nobody's", "s"), (None, f"{lone} x y nobody's", "s"),
           (501, f"start {passage} end", "s"), (501, "quite another text about gardens and trees", "s"),
           (None, f"{passage} without an id", "s"), (None, "weather report for the coming week", "s")]
    spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(60)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    docs = make_docs(rows + odd)
    left = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect()
                             if r.doc_id is None or r.doc_id >= 500)
    named = lambda keep: sorted((str(i), t) for k, (i, t, _) in enumerate(odd) if k in keep)
    mild = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert left(mild) == named({1, 3, 4, 5, 6, 7, 8})
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert left(clean) == named({0, 1, 2, 3, 4, 6, 8})
    once = left(corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)))
    assert once.count(named({3})[0]) == 1 and named({6})[0] in once and named({8})[0] in once
    assert named({5})[0] in once and once.count(named({1})[0]) == 1
