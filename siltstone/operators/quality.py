"""Reject reasons for prose and code: the first rule that fires, or null for a document to keep.

Each function is one column expression, evaluated where the text is read, with no shuffle. Words and lines are bound
once in a lambda, and the rules stop at the first that fires. Null text has no reason (and should be filtered before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: Words of which English prose holds at least two.
STOP_WORDS = "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their".split()
LONGEST_STOP = max(map(len, STOP_WORDS))


def repetition_ratio(lines: Column) -> Column:
    """Share of all lines that repeat an earlier non-blank one."""
    full = F.filter(F.transform(lines, t.strip), lambda x: x != "")
    return F.when(F.size(lines) < 2, 0.0).otherwise((F.size(full) - F.size(F.array_distinct(full))) / F.size(lines))


def top_bigram_ratio(words: Column) -> Column:
    """Twice the most frequent pair of words over all words; 0 below four words."""
    n = F.size(words)
    grams = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def longest_run(s, gram):
        run = F.when(gram == s["last"], s["run"] + 1).otherwise(1)
        return F.struct(gram.alias("last"), run.alias("run"), F.greatest(s["top"], run).alias("top"))

    top = F.aggregate(F.sort_array(grams), start, longest_run, lambda s: s["top"])
    return F.when(n < 4, 0.0).otherwise(top * 2 / n)


def _share(items: Column, test) -> Column:
    return F.size(F.filter(items, test)) / F.size(items)


def prose_reject_reason(text: Column, min_words: int = 50, max_words: int = 100_000) -> Column:
    def rules(x):
        w, ls, body = x["w"], x["ls"], x["t"]
        n = F.size(w)
        mean = F.aggregate(w, F.lit(0).cast("long"), lambda s, y: s + F.length(y)) / n
        symbols = t.occurrences(body, "#") + t.occurrences(body, "...") + t.occurrences(body, "…")
        letter = lambda y: ((y >= "a") & (y < "{")) | ((y >= "A") & (y < "[")) | y.rlike(r"\p{L}")  # noqa: E731  most begin with one
        short = F.filter(w, lambda y: F.length(y) <= LONGEST_STOP)
        stops = F.size(F.array_intersect(F.transform(short, F.lower), F.array(*map(F.lit, STOP_WORDS))))
        bullet = lambda y: F.regexp_replace(y, rf"^[{t.SPACE}]+", F.lit("")).rlike("^[*•-]")
        cut = lambda y: F.regexp_replace(y, rf"[{t.SPACE}]+\z", F.lit("")).rlike(r"(\.\.\.|…)\z")
        return (
            F.when(n < min_words, "too_short")
            .when(n > max_words, "too_long")
            .when((mean < 3.0) | (mean > 10.0), "mean_word_length")
            .when(_share(w, letter) < 0.80, "not_alphabetic")
            .when(stops < 2, "no_stop_words")
            .when(symbols / n > 0.10, "symbol_ratio")
            .when(_share(ls, bullet) > 0.90, "all_bullets")
            .when(_share(ls, cut) > 0.30, "truncated_lines")
            .when(repetition_ratio(ls) > 0.30, "duplicate_lines")
            .when(top_bigram_ratio(w) > 0.20, "repeated_bigram")
        )

    return t.bound(F.struct(text.alias("t"), t.words(text).alias("w"), t.lines(text).alias("ls")), rules)


def code_reject_reason(text: Column, min_chars: int = 200, max_chars: int = 200_000) -> Column:
    def rules(x):
        ls, body = x["ls"], x["t"]
        n = F.length(body)
        return (
            F.when(n < min_chars, "too_short")
            .when(n > max_chars, "too_long")
            .when(n / F.size(ls) > 200, "likely_minified")
            .when(F.array_max(F.transform(ls, F.length)) > 2000, "very_long_line")
            .when(t.alnum_count(body) / n < 0.25, "low_alphanumeric")
            .when(t.occurrences(body, " ") / n < 0.02, "no_whitespace")
            .when(repetition_ratio(ls) > 0.50, "duplicate_lines")
        )

    return t.bound(F.struct(text.alias("t"), t.lines(text).alias("ls")), rules)


def reject_reason(text: Column, kind: Column) -> Column:
    """The rules of the document's kind; a kind other than prose or code is an error, empty text is ``empty``."""
    unknown = F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce(kind, F.lit("null")))).cast("string")
    by_kind = F.when(kind == "prose", prose_reject_reason(text)).when(kind == "code", code_reject_reason(text)).otherwise(unknown)
    return F.when(text == "", "empty").otherwise(by_kind)


def normalise_and_judge(docs: DataFrame, text: str = "text", kind: str = "kind", compose: bool = True) -> DataFrame:
    """``docs`` with normalised text and a ``reason`` (null: keep)."""
    out = docs.withColumn(text, t.normalise(F.col(text), compose))
    return out.withColumn("reason", reject_reason(F.col(text), F.col(kind)))


def filter_report(judged: DataFrame) -> DataFrame:
    """Documents by reason, ``kept`` among them."""
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("documents"))
