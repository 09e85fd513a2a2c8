"""The manifest counts every link of 0.8 or more, also those that share no bucket or are not with a bucket's first."""

import random

import duckdb
import numpy as np
import pytest

from siltstone.operators import dedupe
from siltstone.plans import corpus
from siltstone.plans.oracle import ORACLE_SQL
from siltstone.plans.queries import QUERIES


def cut(words, blank=" "):
    """Ten words a line, so that the rules for code keep the text."""
    return "\n".join(blank.join(words[i : i + 10]) for i in range(0, len(words), 10))


def texts():
    """(text, whether it goes): pairs of a similarity of exactly 0.8 and of 0.77, a chain, other cases and spaces, a copy."""
    rng = random.Random(6)
    out = []
    for k in range(60):
        words = [f"{rng.choice('éàñ')}{k}w{i}" for i in range(70)]
        step = 6 if k % 2 else 7  # 54 shingles a text: 48 of 60 shared, or 47 of 61
        out += [(cut(words[:58]), False), (cut(words[step : 58 + step]), k % 2 == 1)]
    words = [f"c{i}" for i in range(160)]
    out += [(cut(words[4 * k : 4 * k + 60]), k > 0) for k in range(25)]
    words = [f"straße{i} Éx" for i in range(40)]
    out += [(cut(words), False), (cut([w.upper().replace("STRASSE", "STRAßE") for w in words]), True), (cut(words, "　 "), True), (cut(words), False)]
    return out


def test_manifest_counts_every_link(spark, tmp_path):
    rows = [(4 * i, text, "s") for i, (text, _) in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    (got,) = QUERIES["corpus_manifest"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert tuple(got) == db.execute(ORACLE_SQL["corpus_manifest"]).fetchone()
    gone = sum(goes for _, goes in texts())
    assert (got.passed_filters, got.removed_exact_duplicates, got.removed_near_duplicates) == (len(rows), 1, gone)


def test_roots_and_texts_without_words(spark):
    rows = [(i + 1, text) for i, (text, _) in enumerate(texts())] + [(900, ""), (901, "  \n"), (902, None), (903, "one two"), (904, "One  two")]
    found = dedupe.all_near_duplicates(spark.createDataFrame(rows, "ord long, text string").repartition(3))
    want = {2 * k + 2: 2 * k + 1 for k in range(1, 60, 2)} | {121 + k: 121 for k in range(1, 25)} | {147: 146, 148: 146, 149: 146, 901: 900, 902: 900, 904: 903}
    assert {r.ord: r.root for r in found.collect()} == want


def test_spread_hashes_stand_for_the_plain_ones():
    words = [f"w{i % 50}" for i in range(400)]
    plain = dedupe._grams([w.encode() for w in words], 5)
    got = dedupe.spread_grams(" ".join(words))
    assert len(plain) == len(got) == len(np.unique(got)) == 50 and got.dtype == np.uint64 and (np.diff(got.astype(object)) > 0).all()
    assert len(dedupe.spread_grams("")) == len(dedupe.spread_grams(None)) == 0


def test_complete_search_takes_no_windows(spark):
    docs = spark.createDataFrame([], "ord long, text string, source string, kind string")
    for args in ({"window": 50_000}, {"window": None, "threshold": 0.9}):
        with pytest.raises(ValueError, match="complete"):
            corpus.build(docs, complete=True, **args)
    assert corpus.manifest(corpus.build(docs, None, complete=True)).first().documents_in == 0
