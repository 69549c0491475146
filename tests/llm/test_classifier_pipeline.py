import zlib

import numpy as np
import pytest

import corpus_pipeline
from mapweave.llm import fm_classifier
from mapweave.llm.fm_classifier import Model, classify, features
from mapweave.llm.simhash import deduplicate, similar_classes
from tests.llm.test_packing import verify
from tests.llm.test_sharding_simhash import corpus

SMALL = "/root/testdata/sf0.01"


def test_margin_is_the_sum_over_pairs():
    r = np.random.default_rng(2)
    model = Model(0.3, r.normal(size=70_000), r.normal(size=(70_000, 4)))
    at, x = features("Some words, some words & more.\nA line", 30)
    pairs = sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert model.margin(at, x) == pytest.approx(0.3 + model.linear[at] @ x + pairs)


def test_rows_scored_together_score_as_alone(monkeypatch):
    r = np.random.default_rng(4)
    model = Model(-0.2, r.normal(size=70_000), r.normal(size=(70_000, 4)))
    rows = [features(" ".join(f"w{k}" for k in range(n)), None) for n in (0, 5, 700, 1, 40)]
    monkeypatch.setattr(fm_classifier, "FLAT", 100)
    assert model.margins(rows) == pytest.approx([model.margin(*x) for x in rows])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x " * 100_000, "a"), (3, "x", "b"), (None, "y", "b")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in classify(docs, none).collect()] == [(0.5, 1)] * 5
    assert classify(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(2, 0), (3, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    assert classify(docs, some).count() == 5


def test_one_row_of_each_component_stays(spark):
    rows = [*corpus(7, 200), (None, "null key here"), (None, "null key here"), (500, "twice"), (500, "twice")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")
    by_class = {}
    for r in similar_classes(docs).collect():
        by_class.setdefault(r.component_id, []).append(r.doc_id)
    for limit in (500_000, 0):
        kept = deduplicate(docs, broadcast_rows=limit)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(c) for c in by_class)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, n, columns = {r.doc_id for r in docs.select("doc_id").collect()}, docs.count(), docs.columns
        docs = stage(spark, docs, SMALL)
        docs.cache()
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept < before and docs.count() < n
        if name != "near duplicates":
            texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
            lost = [i for i in before - kept if labels.get(i) == 1 and len(texts[i].split()) >= 50]
            assert len(lost) <= 0.01 * len(before)
    left = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = corpus_pipeline.STAGES[3][1](spark, docs, SMALL).collect()
    assert verify(left, pieces) < 0.01 * sum(p.length for p in pieces)


def test_classifier_learns_from_documents_that_the_rules_reject(spark, tmp_path):
    """No document labelled 0 reaches the stage, yet it rejects poor texts without a label."""
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(80))) for i in range(120)]
    poor = [(i, " ".join(f"spam{(i * 5 + k * k) % 89}" for k in range(80))) for i in range(200, 320)]
    docs = spark.createDataFrame(good + poor, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(100)] + [(i, 0) for i in range(200, 300)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    came = docs.filter("doc_id < 200 OR doc_id >= 300")
    kept = {r.doc_id for r in corpus_pipeline.keep_by_classifier(spark, came, str(tmp_path)).collect()}
    assert kept == set(range(120))


def test_labelled_rows_that_are_longer_than_one_result_may_be(spark, tmp_path):
    """The features of all labelled rows together are more than the driver may get at once."""
    docs = spark.range(0, 80, 1, 8).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 12000), k -> concat(if(id % 2 = 0, 'a', 'b'), hex(xxhash64(id, k % 9000))))) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(60).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    docs, conf = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.sparkContext._jsc.sc().conf()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf.set("spark.driver.maxResultSize", "2m")
    try:
        kept = corpus_pipeline.keep_by_classifier(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and 0 < kept.count() < 80
    finally:
        conf.remove("spark.driver.maxResultSize")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stages_on_odd_and_on_empty_tables(spark, tmp_path):
    """Null, empty and repeated texts, null keys, and columns with names that the stages would take for themselves."""
    good = [" ".join(f"word{(i * 7 + k * k) % 97}" for k in range(80)) for i in range(40)]
    rows = [(i, t, "v", 0.1, "s", 1) for i, t in enumerate(good)] + [(50, None, "v", 0.1, "s", 1), (51, "", None, None, None, None), (0, good[0], "v", 0.1, "s", 1), (None, good[1] + " more", "v", 0.1, "s", 1), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, verdict_of_rules string, score_of_classifier double, Verdict_Of_Rules_ string, fp int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(20)] + [(3, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert got.columns == docs.columns and got.schema == docs.schema
                assert got.filter("text IS NULL OR text = ''").count() == 0
                assert got.count() <= now.count() and (start is docs) == (got.count() > 0)
            now = got
        assert (now.count() > 0) == (start is docs)
