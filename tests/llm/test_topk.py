import math

import numpy as np
import pytest

from siltstone.llm import _blocks, topk

MOST = (1 << 63) - 1


def brute(rows, scale, every, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    ints = [(i, [math.floor(scale * float(c)) for c in v], v) for i, v in ok]
    out = []
    for q in sorted({i for i, _, _ in ints if i % every == 0}):
        _, a = min((v, x) for i, x, v in ints if i == q)
        found = sorted((-max(-MOST - 1, min(MOST, sum(x * y for x, y in zip(a, w, strict=True)))), i) for i, w, _ in ints if i != q and len(w) == len(a))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(dict.fromkeys(found)) if r < k]
    return out


def got(df, **more):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_products(df, **more).collect())


@pytest.mark.parametrize("block", [32, 4096])
def test_against_brute_force(spark, sf, block):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    assert got(table, every=20, block=block) == brute(rows, 1024, 20, 10)


def test_lengths_that_differ_and_a_skewed_spectrum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24)) * np.geomspace(3, 0.01, 24) * rng.lognormal(0, 1, size=(600, 1))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(df, every=10, block=40, scale=64, k=7) == brute(rows, 64, 10, 7)


def test_partial_sums_leave_few_pairs():
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.normal(size=(2000, 32)) * np.geomspace(4, 0.02, 32))
    q = x[:50]

    class Shared:
        value = {32: np.linalg.svd(x.T @ x)[0]}

    w, c, s = topk.pruned_by(Shared)(x, q, np.ones((50, 2000), bool), np.arange(50), np.full(50, _blocks.LEAST), np.full(50, _blocks.MOST), 5)
    full = q @ x.T
    assert {(a, b) for a, b in zip(w.tolist(), c.tolist(), strict=True)} == {(a, b) for a in range(50) for b in np.flatnonzero(full[a] >= np.sort(full[a])[-5])}
    assert (s == full[w, c]).all()


def test_odd_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(0, same), (100, [1.0, None, 0.0]), (150, None), (200, [float("nan"), 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0]), (None, same), (400, [1.0, 1.0]), (7, [2.0, 1.0]), (500, [])]
    rows += [(i, same) for i in range(1, 30)] + [(3, same), (0, same), (0, [9.0, 9.0, 9.0]), (600, [0.0, 0.0, 0.0]), (31, [-1.0, 0.0, 0.25])]
    df = spark.createDataFrame([(i, v, 1, 0.5, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score double, `a.b` string")
    want = brute(rows, 4, 100, 3)
    assert got(df, scale=4, k=3) == want and [r for r in want if r[0] == 400] == [(400, 1, 7, 48)] and len(want) == 3 + 3 + 1
    assert [r[2] for r in want if r[0] == 0] == [1, 2, 3]
    assert topk.top_products(df.limit(0)).count() == 0 and got(df.filter("vec_id = 400"), scale=4) == []


def test_components_beyond_exact_doubles(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, -3.0]), (2, [-1e18, 2.0]), (3, [9.0, 1e15]), (4, [9.0, 1e15 + 4]), (100, [3.0, 1e14 + 1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(df, scale=1, k=4) == brute(rows, 1, 100, 4)
