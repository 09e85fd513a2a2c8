import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import spelling

TYPES = "doc_id long, text string, word string, n long, `a.b` string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs, noise=199, shortest=6, least=5, ratio=5):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = 1 if doc is None else zlib.crc32(f"{doc}:{w}".encode())
            if h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    form, n_near = {}, Counter()
    for w in n:
        found = [v for v in n if near(w, v)]
        n_near[w] = len(found)
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], n_near[w], n[form[w]] if w in form else None))
    return sorted(out)


def got(spark, docs, **more):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], TYPES)
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **more).collect()))


def test_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()][:20]
    want = brute(docs, noise=7, least=1, ratio=2)
    assert got(spark, docs, noise=7, least=1, ratio=2) == want and sum(r[1] is not None for r in want) > 50


def test_chains_ties_runs_and_letters(spark):
    many = {"colour": 700, "color": 130, "colours": 20, "colouur": 5, "coolour": 5, "aaaaaaa": 40, "aaaaaa": 8, "aaaaaab": 8, "naïvété": 60, "naïvete": 9, "naïveté": 11, "abcdefg": 5, "bacdefg": 5, "straßen": 30, "strassen": 6, "stra×en": 6}
    text = " ".join(" ".join([w] * n) for w, n in many.items())
    docs = [(None, text), (None, text.upper()), (None, None), (None, ""), (None, "1 2 ؟ łódź")]
    want = brute(docs, least=5, shortest=5)
    assert got(spark, docs, least=5, shortest=5) == want
    roots = {w: r for w, _, r, *_ in want}
    assert roots["colouur"] == roots["coolour"] == "colour" and roots["aaaaaab"] in ("aaaaaaa", "aaaaaab")


def test_chain_of_several_steps(spark):
    many = {"abcdefgh": 1, "abcdefgi": 5, "abcdefji": 25, "abcdekji": 125, "abcdlkji": 625, "abcmlkji": 3125}
    docs = [(None, " ".join(f"{w}" for w, n in many.items() for _ in range(n)))]
    found = got(spark, docs, least=1)
    assert found == brute(docs, least=1) and {r[2] for r in found} == {"abcmlkji"}


def test_long_words_empty_tables_and_hot_words(spark):
    long = "ab" * 3000
    docs = [(None, f"{long} {long[:-1]} {long}x " * 5), (3, "hotter " * 50_000), (4, "hotted " * 5), (3, "hotter " * 10)]
    assert got(spark, docs) == brute(docs)
    assert got(spark, [(1, "one two")]) == [] and spelling.variants(spark.createDataFrame([], TYPES)).count() == 0


def test_equal_hashes_of_different_strings_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(0)
    words = {"".join(rng.choice(list("abcd"), int(rng.integers(6, 9)))) for _ in range(150)}
    rows = [(w, int(rng.integers(5, 60)), i) for i, w in enumerate(sorted(words))]
    table = spark.createDataFrame(rows, "word string, n long, wid long")
    all_keys = spelling.deletion_keys

    def crowded(group):
        whole, without, first = all_keys(group)
        return whole % np.uint64(50), without % np.uint64(50), first

    batches = [b for b in table.select("wid", "word").toArrow().to_batches()]
    monkeypatch.setattr(spelling, "deletion_keys", crowded)
    keyed = [r for b in spelling._keyed(batches) for r in b.to_pylist()]
    monkeypatch.undo()
    shared = spark.createDataFrame([(r["key"], r["wid"], r["pos"], r["first"]) for r in keyed], "key long, wid long, pos int, first boolean")
    monkeypatch.setattr(spelling, "_shared_keys", lambda words: shared)
    found = {r.wid: (r.n_near, r.best.word, -r.best.neg) for r in spelling.near_words(table).collect()}
    of = {w: (n, i) for w, n, i in rows}
    want = {}
    for w, (_, i) in of.items():
        others = [v for v in of if near(w, v)]
        if others:
            best = min(others, key=lambda v: (-of[v][0], v))
            want[i] = (len(others), best, of[best][0])
    assert found == want and len(want) > 20


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=97, max_codepoint=99), min_size=5, max_size=5), min_size=2, max_size=30))
def test_keys_are_those_of_the_strings(words):
    _, without, first = spelling.deletion_keys(words)
    whole = {s: k for s, k in zip([w[:i] + w[i + 1 :] for w in words for i in range(5)], without.ravel().tolist(), strict=True)}
    for r, w in enumerate(words):
        for i in range(5):
            s = w[:i] + w[i + 1 :]
            assert whole[s] == int(without[r, i]) == int(spelling.deletion_keys([s])[0][0])
            assert first[r, i] == (i == 0 or w[i] != w[i - 1])
