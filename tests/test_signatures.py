import numpy as np

from siltstone.functions import session
from siltstone.operators import dedupe


def test_minima_equal_the_plain_remainder():
    rng = np.random.default_rng(3)
    a, b = dedupe.permutations(16, 5)
    for x in (rng.integers(0, 1 << 32, 1500, dtype=np.uint64), np.array([0, (1 << 32) - 1], np.uint64), np.zeros(0, np.uint64)):
        want = [min(((int(v) * int(p) + int(q)) % dedupe.PRIME for v in x), default=dedupe.PRIME) for p, q in zip(a, b, strict=True)]
        assert dedupe._minima(x, a, b).tolist() == want


def test_signatures_are_made_once(spark, monkeypatch):
    tags = []
    monkeypatch.setattr(dedupe, "stored", lambda df, tag: tags.append(tag) or session.stored(df, tag))
    docs = spark.createDataFrame([(i, "one two three four five six seven", 0) for i in range(3)], "ord long, text string, window long")
    assert sorted(map(tuple, dedupe.near_duplicates(docs).collect())) == [(1, 0), (2, 0)]
    assert tags.count("signed") == 1
