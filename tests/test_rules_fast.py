from pyspark.sql import functions as F

from siltstone.functions import text as t
from siltstone.operators import quality

ODD = ["", " ", "\n\n\n\n", "a\r\nb\rc", "\x85x ", "　 a  \n\n\n\nb\t\x0b\n", "a\x00b\x7f \x1c\n", "\x1fa", "~!  \n \n \n \nx\r", "\x0cé  ", "a \r b", None, "​ a", "\r\r\r", "\U0001f600 \U0001f600 ", "\xa0", "x\n\x85\n\x85\n\x85\ny"]


def _plain(c):
    """The same as plain regular expressions over whole texts."""
    c = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", F.lit("")), r"\r\n?", F.lit("\n"))
    c = F.regexp_replace(F.regexp_replace(c, rf"[{t.SPACE_NO_LF}]+(?=\n|\z)", F.lit("")), "\n{3,}", F.lit("\n\n"))
    return F.regexp_replace(c, rf"^[{t.SPACE}]+|[{t.SPACE}]+\z", F.lit(""))


def test_normalised_as_by_plain_expressions(spark):
    rows = [(a if a is None or b is None else a + b,) for a in ODD for b in [*ODD, "w"]] + [(chr(c) + "a" + chr(c) + "\n" + chr(c),) for c in [*range(0x300), *range(0x1FF0, 0x2070), 0x1680, 0x3000, 0xFEFF]]
    got = spark.createDataFrame(rows, "text string").select(t.normalise(F.col("text"), compose=False).alias("a"), _plain(F.col("text")).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_only_texts_that_need_it_are_replaced(spark):
    plan = spark.range(1).select(t.lf_only(F.col("id").cast("string"))).selectExpr("*")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains" in plan


def test_words_and_stop_words(spark):
    """Letters of any script count, stop words in any case, also with the Kelvin sign, which is a k in lower case."""
    words = ["THE", "Would", "Kaa", "٣٤", "_1", "É", "中", "ñu", "{x", "2a", "ªb", "Zed", "zoo", "[q", "Their"] * 5
    rows = [(" ".join(words),), (" ".join(["1234", "__a_", "5678"] * 20),), (" ".join(["ABOVE", "ßtraße", "THEIRS"] * 20),), (" ".join(["tHe", "houses", "OF", "trees", "walking"] * 20),)]
    df = spark.createDataFrame(rows, "text string")
    assert [r[0] for r in df.select(quality.prose_reject_reason(F.col("text"))).collect()] == [None, "not_alphabetic", "no_stop_words", "repeated_bigram"]
