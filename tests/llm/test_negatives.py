import math

import numpy as np
import pytest

from siltstone.llm import negatives


def brute(rows, scale=256, every=100, n_positive=5, k=5, share=(4, 5)):
    ok = sorted({(i, y, tuple(v)) for i, y, v in rows if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)})
    ints = [(i, y, [math.floor(scale * float(c)) for c in v], v) for i, y, v in ok]
    out = []
    for a in sorted({i for i, *_ in ints if i % every == 0}):
        label, _, x = min((y, v, w) for i, y, w, v in ints if i == a)
        scored = [(-sum(p * q for p, q in zip(x, w, strict=True)), i, y) for i, y, w, _ in ints if i != a and len(w) == len(x)]
        own = sorted({(s, i) for s, i, y in scored if y == label})[:n_positive]
        for s, i in own:
            found = sorted({(t, j) for t, j, y in scored if y != label and share[0] * -s <= share[1] * -t <= share[1] * -s})
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(found[:k])]
    return sorted(out)


def got(df, **more):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in negatives.hard_negatives(df, **more).collect())


@pytest.mark.parametrize("block", [32, 4096])
def test_against_brute_force(spark, sf, block):
    table = negatives.relabelled(spark.read.parquet(f"{sf}/embeddings.parquet"))
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in table.collect()]
    want = brute(rows, every=25)
    assert got(table, every=25, block=block) == want and len({r[0] for r in want}) >= 15


def test_labels_are_moved(spark):
    df = spark.createDataFrame([(7, [1.0], 9, 1), (8, [1.0], 9, 1), (14, [1.0], None, 1)], "vec_id long, embedding array<double>, label int, part int")
    assert [(r.vec_id, r.label) for r in negatives.relabelled(df).collect()] == [(7, 0), (8, 9), (14, None)]


def test_many_labels_hot_label_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, size=(500, 6)).astype(float)
    labels = np.where(rng.random(500) < 0.4, 0, rng.integers(1, 120, 500))
    rows = [(i, int(y), v) for i, (y, v) in enumerate(zip(labels, x.tolist(), strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    want = brute(rows, 1, 9, 3, 4, (1, 2))
    assert got(df, scale=1, every=9, positives=3, k=4, share=(1, 2), block=50) == want and len(want) > 200


def test_odd_rows(spark):
    a = [2.0, 1.0]
    rows = [(0, 1, a), (0, 1, a), (1, 1, a), (2, 2, [2.0, 0.5]), (3, 2, [2.0, None]), (4, 2, None), (5, None, a), (None, 1, a), (6, 2, [float("nan"), 0.0]), (7, 2, [float("-inf"), 0.0])]
    rows += [(8, 2, []), (9, 2, a), (100, 3, [1.0, 0.0]), (200, 2, [0.0, 0.0]), (10, 2, [0.0, -1.0]), (300, 4, [1.0, 1.0, 1.0]), (0, 2, [5.0, 5.0]), (11, 2, [2.0, 1.0, 0.0]), (400, 1, [-9.0, 0.0])]
    df = spark.createDataFrame([(i, y, v, 1, "x") for i, y, v in rows], "vec_id long, label int, embedding array<float>, rank int, `a.b` string")
    want = brute(rows, 2)
    assert got(df, scale=2) == want and {r[0] for r in want} >= {0, 200}
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_components_beyond_exact_doubles(spark):
    rows = [(0, 1, [1e9, 1.0]), (1, 1, [1e9, 7.0]), (2, 2, [1e9, 5.0]), (3, 2, [1e9, 9.0]), (4, 2, [0.5e9, 1.0]), (5, 3, [0.8e9, 9.0]), (6, 3, [0.8e9, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(df, scale=1) == brute(rows, 1)


def test_planes_drop_most_pairs_before_the_last():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(1500, 16)))
    q, window = x[:20], np.repeat(np.arange(20), 2)
    least, most = np.tile([500_000, 100_000], 20), np.tile([700_000, 200_000], 20)
    w, c, s = negatives.sliced(x, q, np.ones((20, 1500), bool), window, least, most, 3)
    full = (q @ x.T).astype(np.int64)
    for i, r in enumerate(window):
        inside = np.flatnonzero((full[r] >= least[i]) & (full[r] <= most[i]))
        best = set(inside[np.argsort(-full[r][inside], kind="stable")[:3]].tolist())
        assert best <= set(c[w == i].tolist()) <= set(inside.tolist())
    assert (s == full[window[w], c]).all()
