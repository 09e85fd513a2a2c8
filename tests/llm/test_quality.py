import zlib

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import quality


def test_lookup_tables_learn_interactions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in [(a, b) for a, b, _ in model.pairs]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_score_is_a_sum_of_bins():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 2] + x[:, 3] > 0).astype(float))
    for row in x[:5]:
        logit = model.intercept
        for f, (edges, values) in enumerate(zip(model.edges, model.tables, strict=True)):
            logit += values[sum(row[f] >= e for e in edges)]
        for a, b, values in model.pairs:
            logit += values[sum(row[a] >= e for e in model.coarse[a]), sum(row[b] >= e for e in model.coarse[b])]
        assert np.isclose(model.score(row[None])[0], 1 / (1 + np.exp(-logit)))


def test_held_out_accuracy(spark, sf01):
    rows = {r.doc_id: r for r in quality.op1_quality(spark, sf01).collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf01}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(labels) > 50 and sum(r.predicted == q for r, q in labels) / len(labels) >= 0.9


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "fine words, all of them."), (3, "fine words, all of them."), (None, "no id"), (4, "x" * 3_000_000)]
    docs = spark.createDataFrame([(d, t, 0.5, 1) for d, t in rows], "doc_id long, text string, score double, y int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1), (3, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels), into="_s").collect()
    assert len(got) == 6 and all(0 <= r._s <= 1 for r in got)
    empty = quality.train(docs, labels.limit(0))
    assert {r._s for r in quality.score(docs, empty, into="_s").collect()} == {0.5}
    assert quality.score(docs.limit(0), empty).count() == 0


def test_query_scores_against_plain_python(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    want = {r.doc_id: model.score(np.array([quality.features_of(r.text)]))[0] for r in docs.collect()}
    got = quality.op1_quality(spark, sf).collect()
    assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-12 and r.predicted == (r.score >= 0.3) for r in got)


def test_repeated_ids_are_learned_once(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    once, often = quality.train(docs, labels), quality.train(docs.unionByName(docs).unionByName(docs), labels)
    assert all(np.array_equal(a, b) for a, b in zip(once.tables, often.tables, strict=True))


def test_stage_on_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"_score": F.lit(0.7), "SCORE": F.lit("s")})
    odd = spark.createDataFrame([(None, None, None, None, None, 0.7, "s"), (10**9, "", "en", "s", 0, 0.7, "s"), (10**9, "fine " * 500_000, "en", "s", 9, 0.7, "s")], docs.schema)
    out = quality.stage(spark, docs.unionByName(odd).unionByName(odd), sf)
    assert out.columns == docs.columns and {(r._score, r.SCORE) for r in out.collect()} == {(0.7, "s")}
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in docs.collect() if model.score(np.array([quality.features_of(r.text)]))[0] >= 0.3}
    assert {r.doc_id for r in out.collect()} - {None, 10**9} == kept
    assert quality.stage(spark, docs.limit(0), sf).count() == 0
