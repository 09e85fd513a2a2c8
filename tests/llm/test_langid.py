import math
import zlib
from collections import Counter

import numpy as np

from siltstone.llm import langid


def test_words():
    assert langid.words_of("It's 3 o'Clock, Ünïted-x²") == ["it", "s", "o", "clock", "ünïted", "x"]
    assert langid.words_of("a1b_c") == ["a", "b", "c"] and langid.words_of(None) == langid.words_of("12 + 3") == []


def test_fast_paths_find_the_same_words():
    for c in [*range(0x250), *range(0x2000, 0x2070), 0x370, 0x430, 0x2071, 0x300]:
        for text in (f"ab{chr(c)}cd{chr(c)}", f"É{chr(c)}"):
            assert langid.words_of(text) == langid._find()(text.lower()), hex(c)


def brute_model(texts):
    """Languages and the log frequencies of known items, by plain counting."""
    langs = sorted({x for x, t in texts if x and t})
    words = {x: Counter(w for y, t in texts if y == x for w in langid.words_of(t)) for x in langs}
    out = {}
    for kind in range(langid.ORDER + 1):
        counts = words if not kind else {x: Counter(g[-kind:] for w in c.elements() for g in langid.grams_of(w) if len(g) >= kind) for x, c in words.items()}
        share, all_ = (langid.GRAM_SHARE if kind else langid.WORD_SHARE), sum(c.total() for c in counts.values())
        for item in {i for c in counts.values() for i, n in c.items() if n >= share * c.total() and (kind or n > 1)}:
            ns = [c[item] for c in counts.values()]
            out[bool(kind), item] = [math.log((n + langid.PRIOR * sum(ns) / all_) / (c.total() + langid.PRIOR)) for n, c in zip(ns, counts.values(), strict=True)]
    return langs, out


def brute_score(text, langs, known):
    words = langid.words_of(text)
    if not words or not langs:
        return "und", 0.0
    sums = [0.0] * len(langs)
    for w in words:
        for k in range(len(langs)):
            if (False, w) in known:
                sums[k] += known[False, w][k]
                continue
            for gram in langid.grams_of(w):
                while gram and (True, gram) not in known:
                    sums[k] += -3.0
                    gram = gram[1:]
                sums[k] += known[True, gram][k] if gram else 0.0
    odds = [math.exp((s - max(sums)) / len(words) * min(len(words), 20)) for s in sums]
    best = sums.index(max(sums))
    return langs[best], odds[best] / sum(odds)


def test_model_against_brute_force(spark):
    texts = [("en", "the cat and the dog and the bird"), ("de", "der Hund und die Katze und der Vogel"), ("en", "the dog"), (None, "zzz"), ("de", None)]
    model = langid.learn(spark.createDataFrame(texts, "lang string, text string"))
    langs, known = brute_model(texts)
    got = {(k, item): model.table[row] for k, rows in ((False, model.words), (True, model.grams)) for item, row in rows.items()}
    assert model.langs == langs == ["de", "en"] and got.keys() == known.keys()
    assert all(np.allclose(got[k], known[k]) for k in known)


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    learned = [(r.lang, r.text) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    langs, known = brute_model(learned)
    got = {r.doc_id: r for r in langid.op4_language(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = brute_score(r.text, langs, known)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-9


def test_held_out_accuracy(spark, sf01):
    rows = langid.op4_language(spark, sf01).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "de"), (4, "the the end", "en"), (4, "the the end", "en"), (None, "the cat", None), (5, "word " * 200_000, "en"), (6, "一二三", "zh")]
    docs = spark.createDataFrame([(d, t, x, 1.0) for d, t, x in rows], "doc_id long, text string, lang string, score double")
    got = langid.predict(docs, langid.learn(docs)).collect()
    assert len(got) == 8 and all(r.lang_id.lang_pred == "und" and r.lang_id.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(r.lang_id.lang_pred == r.lang for r in got if r.doc_id in (4, 5, 6))
    nothing = langid.learn(docs.limit(0))
    assert {r.lang_id.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), nothing).count() == 0


def test_shares_bound_the_model(spark):
    docs = spark.createDataFrame([("en", " ".join(f"{chr(97 + i)}word " * (40 - i) for i in range(26)))], "lang string, text string")
    model = langid.learn(docs, word_share=0.05)
    assert 0 < len(model.words) <= 20 and "aword" in model.words and "zword" not in model.words


def test_a_rare_language_keeps_its_words_and_all_counts(spark):
    hot = " ".join(f"{chr(97 + i)}hot " * 50 for i in range(20)) + " shared"
    docs = spark.createDataFrame([("aa", hot), ("bb", "rare rare shared shared shared seldom seldom")], "lang string, text string")
    model = langid.learn(docs, word_share=0.04)
    assert {"ahot", "rare", "shared", "seldom"} <= set(model.words)
    n, size = np.array([1, 3]), np.array([1001, 7])
    assert np.allclose(model.table[model.words["shared"]], np.log((n + langid.PRIOR * 4 / 1008) / (size + langid.PRIOR)))


def test_a_language_with_a_ten_thousandth_of_the_rows_is_recognised(spark):
    rng = np.random.default_rng(0)
    lexicon = {x: ["".join(rng.choice(list(letters), 5)) for _ in range(200)] for x, letters in (("en", "abcdefghi"), ("de", "efghijklmn"), ("xx", "klmnopqrst"))}
    text = lambda x, n=30: " ".join(rng.choice(lexicon[x], n))
    rows = [("en", text("en")) for _ in range(6000)] + [("de", text("de")) for _ in range(3999)] + [("xx", text("xx", 300))]
    model = langid.learn(spark.createDataFrame(rows, "lang string, text string"))
    ask = spark.createDataFrame([(x, text(x, 12)) for x in ("xx", "en", "de") for _ in range(50)], "lang string, text string")
    assert all(r.lang == r.lang_id.lang_pred for r in langid.predict(ask, model).collect())


def test_the_result_takes_the_place_of_a_column_of_its_name(spark):
    docs = spark.createDataFrame([("en", "the cat the", "x")], "lang string, text string, LANG_ID string")
    out = langid.predict(docs, langid.learn(docs))
    assert out.columns == ["lang", "text", "lang_id"] and out.first().lang_id.lang_pred == "en"
