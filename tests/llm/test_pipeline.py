"""The pipeline's stages, each on what the one before kept."""

import pytest
from pyspark.sql import functions as F
from test_corpus import clashing, kept_by_brute_force, odd_docs, slow_redaction

import corpus_pipeline
from replimerge.llm import quality_rules, secrets


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name)) + "/out"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_rows(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == stages[0].columns
        assert after.join(before, "doc_id", "left_anti").count() == 0


def test_quality(stages):
    kept = {r.doc_id for r in quality_rules.apply_quality_rules(stages[0]).where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept


def test_copies(stages):
    assert {r.doc_id for r in stages[2].collect()} == kept_by_brute_force({r.doc_id: r.text for r in stages[1].collect()})


def test_leaks(spark, sf, stages):
    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    runs = [" ".join(w[i : i + 12]) for w in items for i in range(len(w) - 11)]
    has = lambda t: any(r in " ".join(t.lower().split()) for r in runs)
    before, after = stages[2].collect(), {r.doc_id for r in stages[3].collect()}
    assert any(has(r.text) for r in before) and all(not has(r.text) for r in before if r.doc_id in after)
    assert all(has(r.text) for r in before if r.doc_id not in after)


def test_secrets(stages):
    model = secrets.train_markov(secrets.labelled_samples(stages[3]))
    after = {r.doc_id: r for r in stages[4].collect()}
    assert len(after) == stages[3].count()
    for r in stages[3].collect():
        assert after[r.doc_id].text == slow_redaction(r.text, model) and after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_mix(spark, sf, stages):
    rows = stages[5].collect()
    assert rows and all(0 < r.taken <= 2 * r.size for r in rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in rows}


def test_odd_and_empty_tables(spark, sf):
    """Every stage on nulls, empty and long texts, repeats and clashing columns; no stage fails on an empty table."""
    docs = clashing(odd_docs(spark))
    want = {"quality_rules": [5, 5, None], "simhash_dedup": [1, 4, 5, 7, None], "decontamination": [1, 2, 3, 4, 5, 5, 7, None], "secret_scans": [1, 2, 3, 4, 5, 5, 7, None]}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        if name in want:
            assert got.columns == docs.columns and sorted((r.doc_id for r in got.select("doc_id").collect()), key=str) == sorted(want[name], key=str), name
        else:
            assert {"doc_id", "text", "kept", "taken"} <= set(got.columns) and got.where(F.col("taken") <= 0).count() == 0
        assert stage(spark, docs.limit(0), sf).count() == 0
