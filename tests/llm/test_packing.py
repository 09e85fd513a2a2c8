import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = open(PATH, encoding="utf-8").read()
TOKENIZER, ENCODER = Tokenizer.from_str(VOCABULARY), packing.ChunkEncoder(VOCABULARY)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aAzZéÉßÀñ0192²'!.,-_ \n\t\x1c\x85 İıΣσ<|>ẞｅ́"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_encode_as_the_whole(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)


def test_special_strings_and_contractions():
    for text in ("a<|endoftext|>b", "it's they'LL don't 'd 's'", "x<|b", "Ünï-cödé ÄÖß", "á b́", ""):
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_bins_hold_everything_once(lengths):
    bins = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 2 * sum(lengths) / 100 + 1  # no two bins are half empty


def test_search_empties_bins():
    lengths = [60, 30, 50, 45, 55, 40, 20]
    bins = packing.local_search([[0], [1, 2], [3], [4], [5], [6]], lengths, 100)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7))


def verify(rows, docs):
    ids = sorted(map(tuple, ((d, tuple(ids_of(t)) + (1,)) for d, t in docs)), key=str)
    by = {}
    for d, x in ids:
        for p, at in enumerate(range(0, len(x), 4096)):
            part = np.array(x[at : at + 4096], "<u4")
            by.setdefault((d, p, at, len(part), zlib.crc32(part.tobytes())), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert by == got
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 for n in at.values())
    return at


def test_against_the_tokenizer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = verify(packing.op9_packing(spark, sf).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert len(at) <= -(-sum(at.values()) // 4096) + 1


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "no id"), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (4, "a" * 5000)]
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, length int, row string")
    verify(packing.best_fit_packing(df, PATH).collect(), rows)
    assert packing.best_fit_packing(df.limit(0), PATH).count() == 0
    kept = packing.best_fit_packing(df.filter("doc_id = 3"), PATH, keep_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in kept)


def test_many_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 3000, 5000))]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3).cache()
    out = packing.pack(parts, group_rows=300).collect()
    assert len(out) == 5000
    assert len({r.sequence_id for r in out}) <= 1.01 * sum(r[3] for r in rows) / 4096 + 2


def test_other_vocabularies_are_encoded_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = Tokenizer.from_file(path)
    texts = ["Hello  World, it's 1234", "", "naïve\n\tÄÖ 一二三 " * 50, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in packing.best_fit_packing(df, path, keep_ids=True).collect()}
    assert got == {k: [*encode.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    assert packing.by_words(VOCABULARY) and not packing.by_words(open(path, encoding="utf-8").read())


def test_long_chunks_are_not_remembered():
    encoder, text = packing.ChunkEncoder(VOCABULARY), "一" * 3000 + " " + "a" * 3000 + " ok 二"
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(text)
    assert max(map(len, [*encoder.words, *encoder.chunks])) <= packing.LONGEST


def test_stage_on_odd_rows(spark):
    rows = [(1, None), (1, "a b c"), (1, "a b c"), (None, "x"), (2, "w " * 9000)]
    df = spark.createDataFrame([(d, t, "en", 1, 2) for d, t in rows], "doc_id long, text string, lang string, piece int, `group` int")
    verify(packing.stage(spark, df, "").collect(), rows)
    assert packing.stage(spark, df.limit(0), "").count() == 0
