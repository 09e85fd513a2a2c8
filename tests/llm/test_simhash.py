import numpy as np
import pytest
import xxhash

from siltstone.llm import simhash


def brute(rows, width=4, radius=4):
    prints = []
    for i, text in rows:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]
        grams = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    codes = np.array([p for _, p in prints], dtype=np.uint64)
    for a in range(len(codes)):
        for b in np.flatnonzero(np.bitwise_count(codes ^ codes[a]) <= radius):
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(prints):
        r = find(k)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return sorted(((i, f"{p:016x}", least[find(k)]) for k, (i, p) in enumerate(prints)), key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(simhash.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(5, None), (2, ""), (3, " \t\n"), (4, "One two"), (9, "one TWO"), (None, "one two"), (7, "a b c d e"), (7, "a b c d e"), (None, "only without id"), (8, "x " * 60000)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, fp int, node string")
    got = result(simhash.near_duplicates(df))
    assert len(got) == len(rows)
    comp = {i: c for i, _, c in got if i is not None}
    assert comp[5] == comp[2] == comp[3] == 2 and comp[9] == 4 and comp[7] == 7
    assert {c for i, _, c in got if i is None} == {4, None}
    assert result(simhash.near_duplicates(df.limit(0))) == []
    assert simhash.stage(spark, df, "").columns == df.columns
    kept = sorted(r.doc_id for r in simhash.stage(spark, df, "").collect() if r.doc_id is not None)
    assert kept == [2, 4, 7, 8] and {(r.doc_id, r.text) for r in simhash.stage(spark, df, "").collect() if r.doc_id is None} == {(None, "only without id")}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_masks_keep_one_shard_equal(k):
    masks = simhash.shard_masks(4, 1 << (10 + 11 * k))
    rng = np.random.default_rng(k)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & m == 0 for m in masks)


def test_forest_finds_every_link():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for c in centre]))
    trees = rng.integers(0, 3, len(codes))
    a, b = simhash.bk_links(codes, trees, 4, most=500)
    d = np.bitwise_count(codes[:, None] ^ codes[None])
    want = {(i, j) for i, j in zip(*np.nonzero((d <= 4) & (trees[:, None] == trees[None])), strict=True) if i < j}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def test_chunked_shards_lose_no_link(spark):
    rng = np.random.default_rng(1)
    codes = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    edges = simhash.links(df, len(codes), least_chunk=16, block=50)
    roots = {r.root for r in simhash.components(edges).collect()}
    assert roots == {int(codes.view(np.int64).min())}
