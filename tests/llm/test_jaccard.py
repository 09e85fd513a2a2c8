import itertools
import random

from pyspark.sql import functions as F

from siltstone.llm import jaccard, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    """The smallest doc_id of each component of all pairs with similarity 0.8 or more."""
    sets = {i: shingles(text) for i, text in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in sets})


def test_stage_against_all_pairs(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_links_between_members_that_are_not_the_first(spark):
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(20)] + [(50 + i, " ".join(words[i : i + 3])) for i in range(3)] + [(90, "a b c d e f"), (91, "A b\tc d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sample in (1, 10_000):
        got = {r.component_id for r in jaccard.near_duplicates(docs, sample).collect()}
        assert sorted(got) == brute(rows) == [0, 50, 51, 52, 90]


def test_a_passage_in_many_documents_hides_no_link(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for k in range(60):
        own = [f"d{k}w{i}" for i in range(rng.randint(40, 240))]
        text = " ".join([*own[:20], passage, *own[20:]])
        rows += [(2 * k, text)] + ([(2 * k + 1, " ".join([*text.split()[:-1], "changed"]))] if k % 3 == 0 else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted({r.component_id for r in jaccard.near_duplicates(docs, 1).collect()}) == brute(rows)


def test_short_texts_with_one_common_phrase(spark):
    rng = random.Random(8)
    rows = [(k, " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(3)), "one phrase of five words", *(f"b{rng.randrange(10**6)}" for _ in range(4))])) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(0, 300, 7)] + [(2000 + k, rows[k][1].rsplit(" ", 1)[0] + " x y") for k in range(0, 300, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted({r.component_id for r in jaccard.near_duplicates(docs).collect()}) == brute(rows)


def test_a_family_of_loose_copies(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words[: rng.randint(130, 150)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted({r.component_id for r in jaccard.near_duplicates(docs).collect()}) == brute(rows)


def test_beginnings_share_what_is_needed(spark):
    rng = random.Random(1)
    sizes = []
    for _ in range(300):
        shared, a, b = rng.randint(1, 400), rng.randint(0, 60), rng.randint(0, 60)
        sets = [set(range(shared)) | {(x, i) for i in range(n)} for x, n in (("a", a), ("b", b))]
        if 5 * shared < 4 * (shared + a + b):
            continue
        order = {t: rng.random() for t in sets[0] | sets[1]}
        starts = [set(sorted(s, key=order.get)[: len(s) // 5 + jaccard.COMMON]) for s in sets]
        sizes.append((len(sets[0]), len(sets[1]), len(starts[0] & starts[1])))
    df = spark.createDataFrame(sizes, "n int, m int, common int")
    assert len(sizes) > 100 and df.filter(F.col("common") < jaccard._needed(F.col("n"), F.col("m"))).isEmpty()


def test_sketches_leave_out_no_pair_that_is_alike(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for _ in range(400):
        both, a, b = (rng.integers(0, 1 << 64, int(rng.integers(0, most)), dtype=np.uint64) for most in (1500, 200, 200))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        shared = len(np.intersect1d(x, y))
        alike = 5 * shared >= 4 * (len(x) + len(y) - shared)
        rows.append((alike, len(x), len(y), *jaccard._parities(x).tolist(), *jaccard._parities(y).tolist()))
    names = ["alike", "n", "m", *[f"{c}_a" for c in jaccard.SKETCH], *[f"{c}_b" for c in jaccard.SKETCH]]
    told = spark.createDataFrame(rows, names).select("alike", jaccard._near_enough("n", "m", "_a", "_b").alias("may"), (5 * F.least("n", "m") >= 4 * F.greatest("n", "m")).alias("sizes"))
    assert told.filter("alike").count() > 100 and told.filter("alike and not may").isEmpty()
    assert told.filter("sizes and not alike and not may").count() > 5
    assert jaccard._parities(np.array([3, 3, 64, 512 + 5], np.uint64)).tolist() == [0, 1, 0, 0, 0, 0, 0, 0, 1 << 5, 0, 0, 0, 0, 0, 0, 0]


def test_a_doc_id_with_several_texts_loses_no_component(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, one), (1, two), (2, one), (3, two), (1, one)]
    for order in (rows, rows[::-1]):
        kept = simhash.stage(spark, spark.createDataFrame(order, "doc_id long, text string").coalesce(1), "").collect()
        assert sorted(map(tuple, kept)) == [(1, one), (1, two)]


def test_shared_shingles_over_small_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = sorted((int(h), int(k), int(k) % 7) for h, k in zip(rng.integers(0, 60, 400), rng.integers(0, 30, 400), strict=True))
    want = {h: sorted({k for x, k, _ in rows if x == h}) for h, _, _ in rows}
    want = sorted((h, k, k % 7, (h + k) % 5, keys[0], keys[0] % 7) for h, keys in want.items() if len(keys) > 1 for k in keys)
    rows = [(h, k, n, (h + k) % 5) for h, k, n in rows]
    for step in (1, 3, 50, 1000):
        batches = [pa.record_batch([pa.array([r[c] for r in rows[at : at + step]], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["h", "key", "n", "place"]) for at in range(0, len(rows), step)]
        got = [tuple(r.values()) for b in jaccard._shared_shingles(batches) for r in b.to_pylist()]
        assert got == want


def test_stage_on_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (5, text.upper()), (3, "x " * 300_000), (3, "x " * 300_000), (None, None), (None, ""), (7, "only one"), (None, "alone here")]
    docs = spark.createDataFrame([(d, t, 1, "k", 2) for d, t in rows], "doc_id long, text string, _key int, `meta.x` string, _bucket int")
    out = simhash.stage(spark, docs, "")
    got = out.collect()
    assert out.columns == docs.columns and {tuple(r)[2:] for r in got} == {(1, "k", 2)}
    assert sorted((r.doc_id or 0, (r.text or "").lower()[:9]) for r in got) == [(0, ""), (0, "alone her"), (3, "x x x x x"), (5, "w0 w1 w2 "), (7, "only one")]
    assert simhash.stage(spark, docs.limit(0), "").count() == 0
