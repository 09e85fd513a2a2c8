"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space to Unicode, as a Java character class body; the second without the line feed.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_NO_LF = SPACE.replace(r"\t-\r", r"\t\x0b-\r")
WORD = r"[\p{L}\p{N}_]+"
#: The same classes, but visible ASCII is turned down by one comparison; Java tries every range of a plain class in turn.
_SPACE, _SPACE_NO_LF = (f"[[^!-~]&&[{s}]]" for s in (SPACE, SPACE_NO_LF))
#: Control characters one by one: Java looks those up in a table.
_CONTROL = "[" + "".join(rf"\x{c:02x}" for c in (*range(9), 11, 12, *range(14, 32), 127)) + "]"


@F.arrow_udf(T.StringType())
def _nfc(texts):
    import pyarrow as pa

    return pa.array([None if (t := x.as_py()) is None else unicodedata.normalize("NFC", t) for x in texts], pa.string())


def nfc(text: Column) -> Column:
    """NFC. Nothing below U+0300 composes, so only texts with later characters reach Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\u02ff]"), text)), text)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    at_end = lambda x: F.left(x, F.lit(1)).rlike(_SPACE) | F.right(x, F.lit(1)).rlike(_SPACE)
    return bound(text, lambda x: F.when(at_end(x), F.regexp_replace(x, rf"^{_SPACE}+|{_SPACE}+\z", F.lit(""))).otherwise(x))


def replaced(text: Column, sign: str, pattern: str, by: str) -> Column:
    """The pattern's matches replaced, in texts that hold the fixed string ``sign``, without which none matches."""
    return bound(text, lambda x: F.when(F.contains(x, F.lit(sign)), F.regexp_replace(x, pattern, F.lit(by))).otherwise(x))


def lf_only(text: Column) -> Column:
    return replaced(text, "\r", r"\r\n?", "\n")


def normalise(text: Column, compose: bool = True) -> Column:
    """NFC, control characters out, LF line ends, no trailing space on lines, at most one blank line, stripped."""
    out = nfc(text) if compose else text
    out = lf_only(F.regexp_replace(out, _CONTROL, F.lit("")))
    out = F.regexp_replace(out, rf"{_SPACE_NO_LF}+(?=\n|\z)", F.lit(""))
    return strip(replaced(out, "\n\n\n", "\n{3,}", "\n\n"))


def clean(text: Column) -> Column:
    """The lighter cleaning of chat turns: LF line ends, at most one blank line, stripped; null becomes empty."""
    return strip(F.regexp_replace(lf_only(F.coalesce(text, F.lit(""))), "\n{3,}", F.lit("\n\n")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def split_space(text: Column) -> Column:
    """Pieces between runs of white space, none empty."""
    return F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+"), F.lit(0))


def occurrences(text: Column, what: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", F.lit("")))


def bound(value: Column, of) -> Column:
    """``of(value)`` with the value computed once: a lambda binds it, where the optimiser might repeat it."""
    return F.element_at(F.transform(F.array(value), of), 1)
