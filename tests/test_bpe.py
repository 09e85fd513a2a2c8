import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.operators import bpe
from siltstone.plans.queries import QUERIES

ODD = ["31415926", "", "日本 \r\n\t x", "a  b   7 8  c\n\n", "it's they'll WE'RE 'x", "🙂🙂 naïve ½²", " ", "x y  z", "aaaaaaaaaaaaaaaaaa" * 40, "  \t 9"]


def merge_all(word, pair, new):
    out, i = [], 0
    while i < len(word):
        if tuple(word[i : i + 2]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


def plain(words, vocab_size, least=2):
    """A trainer that counts everything anew for each merge."""
    words, merges = [(list(w), n) for w, n in words], []
    while bpe.FIRST_MERGE + len(merges) < vocab_size:
        counts = Counter()
        for w, n in words:
            for pair in zip(w, w[1:], strict=False):
                counts[pair] += n
        if not counts or max(counts.values()) < least:
            break
        pair = min(counts, key=lambda p: (-counts[p], p))
        merges.append((*pair, counts[pair]))
        words = [(merge_all(w, pair, bpe.FIRST_MERGE + len(merges) - 1), n) for w, n in words]
    return tuple(merges)


def naive(word, model):
    for i, (a, b, _) in enumerate(model.merges):
        word = merge_all(word, (a, b), bpe.FIRST_MERGE + i)
    return word


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def model(corpus):
    return bpe.train(bpe.word_counts(corpus), 420)


def test_merges_are_those_of_a_plain_trainer(corpus, model):
    counts = [(bpe.symbols_of(r.word), r.n) for r in bpe.word_counts(corpus).collect()]
    assert model.merges == plain(counts, 420) and model.get_vocab_size() == 420


def test_bounds_of_the_rounds_change_nothing(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))): rng.choice([1, 2, 3, 50]) for _ in range(300)} | {"aaaaaaa": 30, "bbbb": 29}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain([(bpe.symbols_of(w), n) for w, n in words.items()], 300)
    for bounds in ({}, {"candidates": 6, "most_symbols": 200}, {"candidates": 9, "most_symbols": 1}):
        assert bpe.train(df, 300, **bounds).merges == want
    assert bpe.train(df.limit(0), 300).merges == () and bpe.train(df, 40_000, min_frequency=10_000).merges == ()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=7), st.integers(1, 4)), min_size=1, max_size=25))
def test_driver_merges_and_independent_pairs(words):
    symbols = [(bpe.symbols_of(w), n) for w, n in words]
    want = plain(symbols, bpe.FIRST_MERGE + 25, 1)
    assert tuple(bpe.sequential(symbols, bpe.FIRST_MERGE, 25, 1)) == want
    counts = Counter()
    for w, n in symbols:
        for pair in zip(w, w[1:], strict=False):
            counts[bpe._code(*pair)] += n
    batch = bpe.independent(sorted(counts.items(), key=lambda x: (-x[1], x[0])))
    assert tuple(batch) == want[: len(batch)] and (batch or not counts)


def test_encoding_and_decoding(spark, corpus, model):
    docs = corpus.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)] + [(-99, None)], "doc_id long, text string"))
    rows = bpe.encode(docs, model).withColumn("back", bpe.decode(F.col("ids"), model)).withColumn("pieces", bpe.pre_tokens("text")).collect()
    public = Tokenizer.from_str(model.to_str())
    for r in rows:
        assert r.ids == public.encode(r.text or "", add_special_tokens=False).ids and r.back == (r.text or "")
    for r in rows[:60] + rows[-11:]:
        assert r.ids == [i for w in (r.pieces or []) for i in naive(bpe.symbols_of(w), model)]
    assert [r.pieces for r in rows if r.text in (ODD[3], ODD[4])] == [["a", " ", " b", "   ", "7", " ", "8", " ", " c", "\n\n"], ["it", "'s", " they", "'ll", " WE", "'", "RE", " '", "x"]]
    broken = spark.createDataFrame([([len(bpe.SPECIAL_TOKENS) + bpe.BYTE_ORDER.index(0xE6), 2],), ([],)], "ids array<int>")
    assert [r.t for r in broken.select(bpe.decode(F.col("ids"), model).alias("t")).collect()] == ["�<|eos|>", ""]


def test_the_public_format(model, tmp_path):
    model.save(str(tmp_path / "t.json"))
    public = Tokenizer.from_file(str(tmp_path / "t.json"))
    assert public.get_vocab() == model.vocabulary() and [model.token_to_id(t) for t in bpe.SPECIAL_TOKENS] == list(range(7))
    assert len({b for b in model.byte_table()}) == model.get_vocab_size()
    with pytest.raises(ValueError):
        bpe.train(None, 70_000)


def test_queries_over_whole_tables(spark, sf, corpus):
    learned = bpe.train(bpe.word_counts(corpus), 4_096)
    assert [tuple(r) for r in QUERIES["bpe_merges"](spark, sf).orderBy("rank").collect()] == [tuple(r) for r in learned.frame(spark).orderBy("rank").collect()]
    public, texts = Tokenizer.from_str(learned.to_str()), {r.doc_id: r.text for r in corpus.collect()}
    rows = QUERIES["bpe_ids"](spark, sf).collect()
    ids = {d: public.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    want = sorted((d, len(x), hashlib.md5(",".join(map(str, x)).encode()).hexdigest(), True) for d, x in ids.items())
    assert sorted(map(tuple, rows)) == want


def test_frame(spark, model):
    rows = model.frame(spark).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(len(model.merges))) and all(r.token == r.left + r.right and r.n > 1 for r in rows)
    assert all(re.fullmatch("([0-9a-f]{2})+", r.token) for r in rows)
