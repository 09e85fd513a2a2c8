import numpy as np
import pytest

from siltstone.llm import ann


def brute(rows, every=50, k=5):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    for q, v in ok:
        if q % every == 0:
            all_ = [(-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), i) for i, w in ok if i != q and len(w) == len(v)]
            out[q] = sorted(all_)[:k]
    return out


def recall(got, want):
    return sum(len({r.vec_id for r in got if r.query_id == q} & {i for _, i in best}) for q, best in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("shard_rows", [64, 4096])
def test_recall_against_brute_force(spark, sf, shard_rows):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = ann.nearest(table, every=5, shard_rows=shard_rows).collect()
    want = brute([(r.vec_id, list(r.embedding)) for r in table.collect()], 5)
    assert recall(got, want) >= 0.97
    for q, best in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id)) and q not in {r.vec_id for r in mine}
        true = {i: -s for s, i in best}
        assert all(abs(r.score - true[r.vec_id]) < 1e-12 for r in mine if r.vec_id in true)


def test_one_large_graph():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 48))
    x = ann._unit(centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 48)))
    near, start = ann.build_graph(x)
    assert near.shape == (3000, 32) and (near < 3000).all()
    found, _ = ann.beam_search(x, near, start, x[:300], 64)
    want = np.argsort(-(x[:300] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(f[:6]) & set(w)) / 6 for f, w in zip(found, want, strict=True)]) >= 0.95


def test_odd_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(0, same), (100, [1.0, None, 0.0]), (150, None), (50, [0.0, 0.0, 0.0]), (200, [float("nan"), 1.0, 1.0]), (250, [float("inf"), 1.0, 1.0]), (None, same), (300, [1.0, 1.0]), (7, [2.0, 1.0]), (350, [])]
    rows += [(i, same) for i in range(1, 20)] + [(3, same), (0, same), (20, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(df).collect())
    assert got == [(0, k, k, 1.0) for k in range(1, 6)] + [(300, 1, 7, round(3 / np.sqrt(10), 9))]
    assert ann.nearest(df.limit(0)).count() == 0


def test_structure_needs_few_cells(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(64, 24))
    x = centres[rng.integers(0, 64, 6000)] + 0.15 * rng.normal(size=(6000, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").cache()
    rows = ann.valid_vectors(df, "vec_id", "embedding")
    graphs, placed, centroids = ann.build_index(rows, shard_rows=200)
    assert len(centroids[24]) == 60 and graphs.count() >= 30
    queries = rows.filter("vec_id % 50 = 0")
    assert ann.cells_needed(queries, placed, centroids, 5, 0.97) <= 6
    want = brute(list(enumerate(x.tolist())))
    assert recall(ann.nearest(df, shard_rows=200).collect(), want) >= 0.95


def test_cosine_of_huge_and_tiny_vectors():
    a, b = np.array([[1e200, 2e200], [1e-200, 0], [3.0, 4.0]]), np.array([[2e200, 1e200], [1e-200, 1e-200], [4.0, 3.0]])
    assert np.allclose(ann.cosine(a, b), [0.8, np.sqrt(0.5), 0.96])
