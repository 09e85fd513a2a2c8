"""Literal rows for every rule, and properties."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as t
from siltstone.operators import chat, dedupe, quality

GOOD = "The river that runs past our town has changed its course twice in a hundred years, and the people who live by it have learned to read the signs. When the snow melts early they move their boats, and when it melts late they wait. My grandmother would say that the water remembers every bank it ever had, and she was not often wrong about such things."
PROSE = [
    ("short.", "too_short"),
    ("the cat and dog " * 25_001, "too_long"),
    ("x " * 500, "mean_word_length"),
    ("aa bb cc " * 200, "mean_word_length"),
    ("the and 12345 67890 " * 30, "not_alphabetic"),
    ("zebra giraffe walrus " * 100, "no_stop_words"),
    ("### " * 500 + " the quick brown fox jumps over a lazy dog " * 20, "symbol_ratio"),
    ("- a bullet point about the thing\n" * 59 + "- a bullet point about the thing", "all_bullets"),
    ("\n".join(f"Line {i} of the text goes on with more than ten words about it..." for i in range(30)), "truncated_lines"),
    ("the quick brown fox jumps over a lazy dog\n" * 80, "duplicate_lines"),
    ("the model and " * 300, "repeated_bigram"),
    (GOOD, None),
    (" ".join(["the of words"] * 16 + ["more here"]), "repeated_bigram"),
]
CODE = [
    ("x = 1", "too_short"),
    ("a = b + c  # d\n" * 20_000, "too_long"),
    ("var a=1;" * 900, "likely_minified"),
    ("\n".join([f"x{i} = a + b" for i in range(40)] + ["ab " * 668]).strip(), "very_long_line"),
    ("\n".join([f"x{i} = a + b" for i in range(40)] + ["ab " * 667]).strip()[:-1], None),
    ("\n".join("{ } ( ) ; , . " for _ in range(60)), "low_alphanumeric"),
    ("\n".join(["A1b2C3d4" * 10] * 200), "no_whitespace"),
    ("\n".join(["value = compute(value) + 1"] * 50), "duplicate_lines"),
    ("\n".join(f"const v{i} = {i} + {i * 7};" for i in range(40)), None),
]


@pytest.mark.parametrize(("rows", "rule"), [(PROSE, quality.prose_reject_reason), (CODE, quality.code_reject_reason)])
def test_reasons(spark, rows, rule):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i int, text string")
    assert [r.r for r in df.orderBy("i").select(rule(F.col("text")).alias("r")).collect()] == [w for _, w in rows]


def test_limits_are_inclusive(spark):
    fifty = " ".join(["the", "of", *(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(48))])
    df = spark.createDataFrame([(fifty,), (fifty.rsplit(" ", 1)[0],)], "text string")
    assert {r.r for r in df.select(quality.prose_reject_reason(F.col("text")).alias("r")).collect()} == {None, "too_short"}


def test_dispatch(spark):
    df = spark.createDataFrame([("\x00\n  ", "prose"), (GOOD, "prose"), (GOOD, "code")], "text string, kind string")
    assert [r.reason for r in quality.normalise_and_judge(df).collect()] == ["empty", None, "likely_minified"]
    with pytest.raises(Exception, match="unknown kind"):
        quality.normalise_and_judge(spark.createDataFrame([("x", "song")], "text string, kind string")).collect()


def py_normalise(x):
    import re

    x = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", unicodedata.normalize("NFC", x)).replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in x.split("\n"))).strip()


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(st.sampled_from("ab é́ \t\n\r\x00\x0b\x1f\x85\xa0  　.#…"), max_size=30), min_size=20, max_size=40))
def test_normalise(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = [r.n for r in df.orderBy("i").select(t.normalise(F.col("text")).alias("n")).collect()]
    assert out == [py_normalise(x) for x in texts]


def test_exact_first_wins_whatever_the_partitions(spark):
    rows = [(i, f"text {i % 7}") for i in range(50)]
    for n in (1, 8):
        df = spark.createDataFrame(rows, "ord long, text string").repartition(n)
        assert sorted(r.ord for r in dedupe.drop_exact_duplicates(df).collect()) == list(range(7))


def test_near_duplicates_and_windows(spark):
    words = [f"w{i}" for i in range(120)]
    near = [*words[:60], "changed", *words[61:]]
    rows = [(0, " ".join(words)), (1, " ".join(f"z{i}" for i in range(100))), (2, " ".join(near)), (3, "a b"), (4, "A  b"), (5, ""), (6, "")]
    df = spark.createDataFrame(rows, "ord long, text string")
    for n in (1, 5):
        kept = dedupe.windowed_near_dedupe(df.repartition(n), window=None)
        assert sorted(r.ord for r in kept.collect()) == [0, 1, 3, 5]
    assert sorted(r.ord for r in dedupe.windowed_near_dedupe(df, window=2).collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert dedupe.windowed_near_dedupe(df.limit(0)).count() == 0


def test_estimate_follows_similarity(spark):
    """Multipliers below 2^32 mix weakly, so single estimates scatter; their mean does not."""
    rows = [(" ".join(f"w{k}x{i}" for i in range(400)), " ".join(f"w{k}x{i}" for i in range(100, 500))) for k in range(60)]
    df = spark.createDataFrame(rows, "a string, b string").select(*[dedupe.shingle_hashes(F.col(c)).alias(c) for c in "ab"])
    got = df.select(dedupe.jaccard(F.col("a"), F.col("b")).alias("j"), dedupe.minhash(F.col("a")).alias("x"), dedupe.minhash(F.col("b")).alias("y")).collect()
    error = [sum(p == q for p, q in zip(r.x, r.y, strict=True)) / 128 - r.j for r in got]
    assert abs(sum(error) / len(error)) < 0.1
    assert abs(dedupe.estimate_threshold(16, 8) - 0.707) < 0.001
    with pytest.raises(ValueError, match="bands"):
        dedupe.lsh_candidates(df, 128, 7)


def turn(role, content):
    return {"role": role, "content": content}


U, A = turn("user", "What is a river made of?"), turn("assistant", "Mostly of water, and of what it carries.")
CONVERSATIONS = [
    ([U, A], None),
    ([turn("system", "Be brief."), U, A], None),
    ([], "empty"),
    ([U], "does_not_end_with_assistant"),
    ([A], "no_user_turn"),
    ([turn("system", "a"), turn("system", "b"), U, A], "multiple_system_turns"),
    ([U, turn("system", "a"), A], "system_turn_out_of_place"),
    ([U, U, A], "roles_do_not_alternate"),
    ([turn("user", "x" * 24_001), A], "too_long"),
    ([U, turn("assistant", "short")], "answer_too_short"),
    ([U, turn("assistant", "As an AI language model, I have no rivers.")], "refusal_or_meta"),
    ([U, turn("assistant", "I'm sorry, but I can not say."), U, turn("assistant", "no")], "refusal_or_meta"),
]
PAIRS = [
    (("What is 2+2?", "It is four, as anyone would say.", "I would rather not tell you that."), None),
    (("What is 2+2?", " the same answer, twice over ", "the same answer, twice over"), "identical_responses"),
    (("too short", "x" * 20, "y" * 20), "prompt_too_short"),
    (("What is 2+2?", "four", "y" * 20), "chosen_too_short"),
    (("What is 2+2?", "x" * 20, "four"), "rejected_too_short"),
    (("What is 2+2?", "x" * 12_000, "y" * 20), "too_long"),
    (("What is 2+2?", "I cannot fulfill that request.", "y" * 20), "chosen_is_a_refusal"),
]


def test_conversation_rules(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(CONVERSATIONS)], f"i int, messages {chat.MESSAGES}")
    assert [r.r for r in df.orderBy("i").select(chat.conversation_reject_reason(F.col("messages")).alias("r")).collect()] == [w for _, w in CONVERSATIONS]


def test_preference_rules(spark):
    df = spark.createDataFrame([(i, dict(zip(("prompt", "chosen", "rejected"), p, strict=True))) for i, (p, _) in enumerate(PAIRS)], "i int, p struct<prompt: string, chosen: string, rejected: string>")
    assert [r.r for r in df.orderBy("i").select(chat.preference_reject_reason(F.col("p")).alias("r")).collect()] == [w for _, w in PAIRS]


def test_adapters(spark):
    df = spark.createDataFrame([([("Human", " hi\r\nthere\n\n\n\nx "), ("gpt", "yes")],), ([("wizard", "a"), ("gpt", "b")],), ([("human", "a"), ("gpt", " ")],), ([],), (None,)], "c array<struct<from: string, value: string>>")
    out = [r.m for r in df.select(chat.adapt_sharegpt(F.col("c")).alias("m")).collect()]
    assert [tuple(m) for m in out[0]] == [("user", "hi\nthere\n\nx"), ("assistant", "yes")] and out[1:] == [None] * 4
    df = spark.createDataFrame([("p", "", "q", "s", "more"), (None, "i", None, "", "x"), (" ", "i", None, "s", None)], "problem string, instruction string, question string, solution string, input string")
    out = [r.m for r in df.select(chat.adapt_instruct_pair([F.col("problem"), F.col("instruction"), F.col("question")], [F.col("solution")], F.col("input")).alias("m")).collect()]
    assert [tuple(m) for m in out[0]] == [("user", "p\n\nmore"), ("assistant", "s")] and out[1:] == [None, None]
    turns = "array<struct<role: string, content: string>>"
    df = spark.createDataFrame([("", [("user", "ask"), ("assistant", "a"), ("assistant", "b")], [("assistant", "c")]), ("p", [("gpt", "a")], [("assistant", "c")]), ("p", None, [])], f"prompt string, chosen {turns}, rejected {turns}")
    out = [r.p for r in df.select(chat.adapt_preference_messages(*map(F.col, df.columns)).alias("p")).collect()]
    assert tuple(out[0]) == ("ask", "b", "c") and out[1:] == [None, None]
    df = spark.createDataFrame([(None, "q", "a", None, "b"), ("", "", "a", "a", "b")], "prompt string, question string, chosen string, response_a string, rejected string")
    out = [r.p for r in df.select(chat.adapt_preference_flat([F.col("prompt"), F.col("question")], [F.col("chosen"), F.col("response_a")], [F.col("rejected")]).alias("p")).collect()]
    assert tuple(out[0]) == ("q", "a", "b") and out[1] is None


def test_render(spark):
    df = spark.createDataFrame([([U, A],)], f"m {chat.MESSAGES}")
    text = df.select(chat.render(F.col("m"), True)).first()[0]
    assert text == f"<|bos|><|user|>{U['content']}<|end|><|assistant|>{A['content']}<|end|><|assistant|>"
    with pytest.raises(Exception, match="unknown role"):
        spark.createDataFrame([([turn("wizard", "x")],)], f"m {chat.MESSAGES}").select(chat.render(F.col("m"))).collect()


def test_prompts_seen_only_if_taken(spark):
    """The first source takes one of its two prompts; the other stays free for the second source."""
    items = spark.createDataFrame([(0, "a", "k1", None), (1, "a", "k2", None), (2, "a", "k3", "bad"), (3, "b", "k1", None), (4, "b", "k2", None), (5, "b", "k3", None)], "ord long, source string, key string, reason string")
    got = chat.collect_mix(items, [("a", 0.25), ("b", 0.75)], 4, read_multiplier=3).collect()
    assert sorted((r.source, r.ord) for r in got) == [("a", 0), ("b", 4), ("b", 5)]
    assert [r.ord for r in chat.collect_mix(items, [("a", 0.25), ("b", 0.75)], 2, only="b", read_multiplier=1).collect()] == [3, 4]


@pytest.mark.parametrize(("n", "fraction", "val"), [(0, 0.1, 0), (1, 0.1, 1), (10, 0.25, 2), (3, 0.0, 1)])
def test_split(spark, n, fraction, val):
    rows = chat.train_val_split(spark.range(n), ["id"], fraction).collect()
    assert len(rows) == n and {r.id for r in rows if r.is_val} == set(range(val))
