import hashlib
import random
import re

from pyspark.sql import functions as F

from siltstone.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names |= {str(name)} if name is not None else set()
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        alphabet = "abcd"[: rng.randint(2, 4)]
        items = [(str(k), "".join(rng.choice(alphabet) + " " for _ in range(rng.randint(0, 9)))) for k in range(6)]
        machine = decontam.SuffixAutomaton([(n, decontam.words_of(t)) for n, t in items], 4)
        text = "".join(rng.choice(alphabet + "x") + " " for _ in range(40))
        spans, names = machine.scan(decontam.words_of(text))
        n, hit, n_items, digest, _ = brute(text, items, 4)
        assert sum(b - a + 1 for a, b in spans) == hit
        assert hashlib.sha256(",".join(sorted(names)).encode()).hexdigest() == digest


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in decontam.op6_decontamination(spark, sf).collect()}
    assert got == {d: brute(t, items) for d, t in docs} and any(v[-1] for v in got.values())


def frames(spark):
    passage = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, passage, 0), (1, passage, 1), (2, None, 0), (None, "no id here", 0), (3, "tiny item", 0), (4, "", 0)], "item_id long, text string, hits int")
    rows = [(1, None), (2, ""), (3, "x " * 20 + passage.upper() + " y" * 20), (4, passage), (5, "a Tiny  ITEM."), (6, "nothing"), (6, "nothing"), (None, "no id here"), (7, "word " * 100_000)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, items


def test_odd_rows(spark):
    docs, items = frames(spark)
    listed = [(r.item_id, r.text) for r in items.collect() if r.text is not None]
    for most in (200_000, 3):
        got = decontam.hits(docs, items, most_words=most).collect()
        assert len(got) == docs.count()
        for r in got:
            n, hit, n_items, _, _ = brute(r.text, listed)
            assert (r.hits.n_words, sum(s.last - s.first + 1 for s in r.hits.spans), len(r.hits.items)) == (n, hit, n_items)
    assert decontam.hits(docs.limit(0), items).count() == 0
    assert all(not r.hits.items for r in decontam.hits(docs, items.limit(0)).collect())


def test_spans_are_removed(spark):
    docs, items = frames(spark)
    for most in (200_000, 3):
        got = sorted(((r.doc_id, r.text) for r in decontam.decontaminate(docs, items, most_words=most).collect()), key=str)
        check_kept(got)


def check_kept(got):
    kept = {d: t for d, t in got}
    assert 4 not in kept and 5 not in kept and None not in kept and 6 in kept and len(got) == 6
    assert words(kept[3]) == ["x"] * 20 + ["y"] * 20 and kept[7] == "word " * 100_000


def test_joined_ends_are_scanned_again(spark):
    items = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "item_id long, text string")
    text = "start e f A b, c. d g h end " + "more " * 20
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for most in (200_000, 3):
        assert words(decontam.decontaminate(docs, items, window=4, most_words=most).first().text) == ["start", "end", *["more"] * 20]


def test_coverage_does_not_depend_on_the_number_of_automata(spark):
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(10))) for k in range(6)], "item_id long, text string")
    half = " ".join(f"i{k}w{j}" for k in range(6) for j in range(10))
    rows = [(1, f"{half} {'x ' * 59}"), (2, f"{half} {'x ' * 61}"), (3, "clean"), (3, "clean"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10, 25, 200_000):
        got = sorted((r.doc_id, r.text and words(r.text)) for r in decontam.decontaminate(docs, items, most_words=most).collect())
        assert got == [(2, ["x"] * 61), (3, ["clean"]), (3, ["clean"]), (4, None)]


def test_clashing_columns(spark):
    docs, items = frames(spark)
    names = ["_cleaned", "_key", "_keep", "_left", "_items", "_spans", "_bucket", "hits"]
    odd = docs.select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for most in (200_000, 3):
        clean = decontam.decontaminate(odd, items, most_words=most)
        assert clean.columns == odd.columns and {tuple(r)[2:] for r in clean.collect()} == {tuple(range(len(names)))}
        judged = decontam.hits(odd, items, most_words=most)
        assert judged.columns == odd.columns and all(r.hits.n_words is not None and r._spans == 5 for r in judged.collect())


def test_stage_on_odd_rows(spark, sf):
    docs, _ = frames(spark)
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    extra = spark.createDataFrame([(8, passage, "en", "s", 1), (9, f"{'x ' * 300} {passage} end", "en", "s", 1), (10, None, None, None, None)], docs.schema)
    out = decontam.stage(spark, docs.unionByName(extra), sf)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and 8 not in got and words(got[9].text) == ["x"] * 300 + ["end"] and got[9].n_chars == len(got[9].text)
    assert got[1].n_chars == 1 and got[10].n_chars is None and got[7].n_chars == 500_000
    assert decontam.stage(spark, docs.limit(0), sf).count() == 0
