"""Families of loose near copies become components by a few pairs a member; edges are looked at until they are joined."""

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import jaccard, simhash


def family(members, seed=0):
    """Texts of 150 words, of which one to three were replaced: about half of all pairs are links."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(members):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(1, 4)):
            words[at] = f"x{rng.integers(0, 1 << 40)}"
        texts.append(" ".join(words))
    return texts


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_family_by_few_pairs(spark, monkeypatch):
    texts = family(400)
    sets = [set(jaccard.shingles_of(t).tolist()) for t in texts]
    links = [(i, j) for i in range(400) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    rows, plain = {}, jaccard.written

    def counted(df, tag, files=None):
        out = plain(df, tag, files)
        rows[tag] = rows.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(jaccard, "_proposed", lambda nodes, many: spark.createDataFrame([], "a long, b long"))  # fingerprints alone would join these
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(roots(400, links)))
    assert len(links) > 20_000 and rows["across"] < 400 and rows["edges"] < 12 * 400


def test_next_ones_across_batches():
    rng = np.random.default_rng(3)
    n = 300
    h, part = np.sort(rng.integers(0, 4, n)), rng.integers(0, 3, n)
    key, size = rng.permutation(n), rng.integers(8, 12, n)
    sketch = np.zeros((n, len(jaccard.SKETCH)), np.int64)
    sketch[:, 0] = (1 << rng.integers(0, 3, n)) - 1
    table = pa.table([h, key, pa.array(size, pa.int32()), part, *sketch.T.copy()], names=["h", "key", "n", "part", *jaccard.SKETCH])
    want = set()
    for i in range(n):
        for j in range(max(0, i - jaccard.NEXT), i):
            near = 9 * int(np.bitwise_count(sketch[i] ^ sketch[j]).sum()) <= size[i] + size[j] and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])
            if h[i] == h[j] and part[i] != part[j] and near:
                want.add((int(min(key[i], key[j])), int(max(key[i], key[j]))))
    for rows in (1, 5, 64, n):
        got = [tuple(p.values()) for b in jaccard._next_ones(table.to_batches(rows)) for p in b.to_pylist()]
        assert set(got) == want


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components(spark, kind):
    n = 600
    rng = np.random.default_rng(5)
    some = {"path": [(i + 1, i) for i in range(n - 1)], "star": [(i, 0) for i in range(1, n)], "random": [(int(max(p)), int(min(p))) for p in rng.integers(0, n, (n // 2, 2)) if p[0] != p[1]]}[kind]
    edges = spark.createDataFrame(some, "a long, b long")
    want = roots(n, some)
    assert {r.node: r.root for r in simhash.components(edges, 2).collect()} == {i: want[i] for p in some for i in p}
    assert simhash.components(edges.limit(0), 2).isEmpty()
