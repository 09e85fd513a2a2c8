import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import quality

from .test_decontam import brute as hits_of
from .test_packing import verify
from .test_secretscan import PLANTED
from .test_jaccard import brute as survivors_of


def test_every_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names, before = docs.columns, docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf).cache()
        a, b = {r.doc_id: r for r in before.collect()}, after.collect()
        if name != "best_fit_packing":
            assert after.columns == names and len({r.doc_id for r in b}) == len(b)
            assert all(r.n_chars == len(r.text) for r in b)
        if name == "quality_classifier":
            model = quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
            keep = {d for d, r in a.items() if model.score(np.array([quality.features_of(r.text)]))[0] >= 0.3}
            assert {r.doc_id for r in b} == keep and 0.5 < len(b) / len(a) < 1
            assert all(r == a[r.doc_id] for r in b)
        elif name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in b) == survivors_of([(d, r.text) for d, r in a.items()])
            assert len(b) < len(a) and all(r == a[r.doc_id] for r in b)
        elif name == "benchmark_decontamination":
            dirty = {d for d, r in a.items() if hits_of(r.text, items)[-1]}
            assert dirty and {d for d in a if d not in dirty} <= {r.doc_id for r in b}
            assert all(not hits_of(r.text, items)[-1] and (r.doc_id in dirty or r == a[r.doc_id]) for r in b)
        elif name == "secret_scans":
            assert {r.doc_id for r in b} == set(a) and not any(PLANTED.search(r.text) for r in b)
            assert all(r.text == PLANTED.sub("[secret]", a[r.doc_id].text) for r in b)
        else:
            verify(b, [(d, r.text) for d, r in a.items()])
        seen.append((name, len(a), len(b)))
        before = after
    assert [n for n, *_ in seen] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    tokens = sum(r.length for r in corpus_pipeline.run(spark, sf).collect())
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert tokens == sum(len(encode.encode(r.text, add_special_tokens=False).ids) + 1 for r in a.values())


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
