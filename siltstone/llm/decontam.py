"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds the word sequences of all test items. Training texts are streamed through it word by word; its
state and the length of the longest match that ends at each word tell whether one of the items' windows (``window``
consecutive words, or a whole shorter item) ends there. Stretches of words that no item knows cannot match, so only
runs of known words are walked.

Items are few against the corpus, but their size is checked: above ``most_words`` they are dealt into several automata.
Each is made, broadcast, applied in a pass of its own and dropped, so neither the driver nor a worker holds two. Such a
pass stores only the texts that are hit, by their digest; their spans are then merged over all automata, so that the
result is the same for every ``most_words``. Documents are shuffled only to meet those few texts, and only if their
digest may be among them; with one automaton they never are.

Defined results: null and empty texts have no words and are clean. Items without words take no part; an item without an
id hits words like any other, but is not among the names and numbers of items. Repeated items count once. Repeated
documents are each judged, extra columns stay (but the result takes the place of a column of its name), an empty table
on either side gives clean or no rows.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import met, modest_batches, private, table, with_results, written

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: ASCII upper case to lower case, everything outside words to a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

_SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN))])


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of items, with the windows of ``window`` words and the shorter items marked."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, sequence in sequences:
            last = 0
            for token in sequence:
                last = self._extend(last, token)
        self.windows: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        self.least = min([window, *(len(s) for _, s in sequences)])
        for name, sequence in sequences:
            state = matched = 0
            for token in sequence:
                state, matched = self._step(state, matched, token)
                if matched >= window:
                    self.windows.setdefault(self._window_state(state), set()).add(name)
            if len(sequence) < window:
                self.short.setdefault(state, []).append((len(sequence), name))

    def _extend(self, last: int, token: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if token in nxt[last]:
            q = nxt[last][token]
            return q if length[q] == length[last] + 1 else self._clone(last, token, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and token not in nxt[at]:
            nxt[at][token] = new
            at = link[at]
        if at >= 0:
            q = nxt[at][token]
            link[new] = q if length[q] == length[at] + 1 else self._clone(at, token, q)
        return new

    def _clone(self, at: int, token: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[at] + 1)
        link.append(link[q])
        link[q] = copy
        while at >= 0 and nxt[at].get(token) == q:
            nxt[at][token] = copy
            at = link[at]
        return copy

    def _step(self, state: int, matched: int, token: int) -> tuple[int, int]:
        nxt = self.next
        while state and token not in nxt[state]:
            state = self.link[state]
            matched = self.length[state]
        if token in nxt[state]:
            return nxt[state][token], matched + 1
        return 0, 0

    def _window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a match at least that long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (first and last index, merged) and the items whose windows occur."""
        n, found, spans = len(words), set(), []
        if n < self.least or not self.ids:
            return spans, found
        get = self.ids.get
        tokens = np.fromiter((get(w, -1) for w in words), np.int64, n)
        breaks = np.concatenate([[-1], np.flatnonzero(tokens < 0), [n]])
        runs = np.flatnonzero(np.diff(breaks) - 1 >= self.least)
        for first, end in zip((breaks[runs] + 1).tolist(), breaks[runs + 1].tolist(), strict=True):
            state = matched = 0
            for at, token in enumerate(tokens[first:end].tolist(), first):
                state, matched = self._step(state, matched, token)
                hit = 0
                if matched >= self.window:
                    found |= self.windows[self._window_state(state)]
                    hit = self.window
                if self.short:
                    up = state
                    while up > 0:
                        for size, name in self.short.get(up, ()):
                            if size <= matched:
                                found.add(name)
                                hit = max(hit, size)
                        up = self.link[up]
                if hit:
                    lo = at - hit + 1
                    while spans and lo <= spans[-1][1] + 1:
                        lo = min(lo, spans.pop()[0])
                    spans.append((lo, at))
        found.discard(None)
        return spans, found


_SPANS = "array<struct<first: int, last: int>>"


def _scanner(automaton):
    @F.arrow_udf(HITS)
    def scan(texts):
        import pyarrow as pa

        machine, out = automaton.value, []
        for text in texts:
            words = words_of(text.as_py())
            spans, items = machine.scan(words)
            out.append({"n_words": len(words), "items": sorted(items), "spans": [{"first": a, "last": b} for a, b in spans]})
        spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", spans_type)]))

    return scan


@F.arrow_udf(T.LongType())
def _n_words(texts):
    import pyarrow as pa

    return pa.array([len(words_of(t.as_py())) for t in texts], pa.int64())


@F.arrow_udf(T.ArrayType(_SPAN))
def _merged_spans(lists):
    """Spans of several automata as one list, without overlaps."""
    import pyarrow as pa

    out = []
    for spans in lists.to_pylist():
        merged: list[dict] = []
        for s in sorted(spans, key=lambda s: s["first"]):
            if merged and s["first"] <= merged[-1]["last"] + 1:
                merged[-1]["last"] = max(merged[-1]["last"], s["last"])
            else:
                merged.append(s)
        out.append(merged)
    return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))


class Automata:
    """The items, dealt into automata of at most about ``most_words`` words each (one item at least)."""

    def __init__(self, items: DataFrame, window: int, most_words: int, id_col: str = "item_id", text: str = "text"):
        rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).filter("text is not null").distinct()
        size = rows.agg(F.sum(F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))).alias("n")).first()["n"] or 0
        self.shards, self.window, self.rows = max(1, -(-size // most_words)), window, rows

    def machine(self, k: int):
        """Automaton ``k``, broadcast."""
        part = self.rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(self.shards)) == k) if self.shards > 1 else self.rows
        rows = part.orderBy("id", "text").toLocalIterator()
        return self.rows.sparkSession.sparkContext.broadcast(SuffixAutomaton([(r.id, words_of(r.text)) for r in rows], self.window))

    def sweep(self, texts: DataFrame) -> DataFrame:
        """(key, text, n_words, items, spans) of the hit ones among texts (key, text), over all automata; a row a key."""
        found = None
        for k in range(self.shards):
            machine = self.machine(k)
            hit = texts.select("key", "text", _scanner(machine)(F.col("text")).alias("h")).filter(F.size("h.spans") > 0)
            part = written(hit.groupBy("key").agg(F.first("text").alias("text"), F.first("h").alias("h")), "hits")
            machine.destroy()
            found = part if found is None else found.unionByName(part)
        names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items"))))
        merged = found.groupBy("key").agg(F.first("text").alias("text"), F.first("h.n_words").alias("n_words"), names.alias("items"), F.flatten(F.collect_list("h.spans")).alias("spans"))
        return written(merged.withColumn("spans", _merged_spans("spans")), "swept")


def _digest(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def hits(docs: DataFrame, items: DataFrame, window: int = 10, most_words: int = 200_000, text: str = "text", into: str = "hits") -> DataFrame:
    """``docs`` with a struct of n_words, the item ids whose windows occur (sorted) and the spans of hit words."""
    modest_batches(docs.sparkSession)
    automata, names = Automata(items, window, most_words), docs.columns
    if automata.shards == 1:
        return docs.select(with_results(docs, names, {into: _scanner(automata.machine(0))(F.col(text))}))
    key, items_, spans = private(docs, "key", "items", "spans")
    found = automata.sweep(docs.select(_digest(text).alias("key"), F.col(text).alias("text")))
    found = written(found.select(F.col("key").alias(key), F.col("items").alias(items_), F.col("spans").alias(spans)), "found")
    out = met(docs, _digest(text), found, key)
    none = F.expr(f"cast(array() as {_SPANS})")
    result = F.struct(_n_words(F.col(text)).alias("n_words"), F.coalesce(items_, F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce(F.col(spans), none).alias("spans"))
    return out.select(with_results(out, names, {into: result}))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given spans of words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    kept, last = [], 0
    for first, end in spans:
        kept.append(raw[last : at[first][0]])
        last = at[end][1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")


def _cleaner(automaton):
    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())]))
    def cleaned(texts):
        """What is left of a text that is hit (null for others), its words, and those hit at first."""
        import pyarrow as pa

        machine, out = automaton.value, []
        for text in texts:
            left = None
            words = words_of(data := text.as_py())
            n_words, n_hit = len(words), 0
            while spans := machine.scan(words)[0]:  # what stood around a span may match when it is gone
                n_hit = n_hit or sum(b - a + 1 for a, b in spans)
                data = left = without(data, spans)
                words = words_of(left)
            out.append((left, n_words, n_hit))
        return pa.StructArray.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["text", "n_words", "n_hit"])

    return cleaned


@F.arrow_udf(T.StringType())
def _cut(texts, spans):
    import pyarrow as pa

    return pa.array([without(t.as_py(), [(s["first"], s["last"]) for s in p.as_py()]) for t, p in zip(texts, spans, strict=True)], pa.string())


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_words: int = 200_000, most_coverage: float = 0.5, text: str = "text") -> DataFrame:
    """Removes hit spans until none is left; a document of which more than ``most_coverage`` is hit at first goes.

    With one automaton this is a single pass. Several sweep over all texts once, and then over the cut ones until no
    sweep finds anything.
    """
    modest_batches(docs.sparkSession)
    automata, names = Automata(items, window, most_words), docs.columns
    if automata.shards == 1:
        (own,) = private(docs, "cleaned")
        cleaned = _cleaner(automata.machine(0)).asNondeterministic()  # else the filter gets a call of its own
        judged = docs.withColumn(own, cleaned(F.col(text))).filter(F.col(f"{own}.n_hit") <= F.lit(most_coverage) * F.col(f"{own}.n_words"))
        return judged.withColumn(text, F.coalesce(F.col(f"{own}.text"), F.col(text))).select(*[F.col(f"`{n}`") for n in names])
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    swept = automata.sweep(docs.select(_digest(text).alias("key"), F.col(text).alias("text")))
    first = swept.withColumn("keep", n_hit <= F.lit(most_coverage) * F.col("n_words"))
    turns = [written(first.select("key", "keep", F.when(F.col("keep"), _cut("text", "spans")).alias("text"), F.lit(0).alias("turn")), "cut")]
    texts = turns[0].filter("keep").select("key", "text")
    while not (swept := automata.sweep(texts)).isEmpty():  # what stood around a span may match when it is gone
        turns.append(written(swept.select("key", F.lit(True).alias("keep"), _cut("text", "spans").alias("text"), F.lit(len(turns)).alias("turn")), "cut"))
        texts = turns[-1].select("key", "text")
    key, keep, left = private(docs, "key", "keep", "left")
    all_ = functools.reduce(DataFrame.unionByName, turns).groupBy(F.col("key").alias(key)).agg(F.min("keep").alias(keep), F.max_by("text", "turn").alias(left))
    out = met(docs, _digest(text), written(all_, "cut"), key)
    out = out.filter(F.coalesce(F.col(keep), F.lit(True))).withColumn(text, F.coalesce(F.col(left), F.col(text)))
    return out.select(*[F.col(f"`{n}`") for n in names])


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document."""
    judged = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    out = judged.select("doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


#: The same in DuckDB: windows and the documents' word runs of the same lengths meet on their text.
OP6_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)
), gram AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT r, i, gram.n AS n, id FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(generate_series(0, n - 1)) AS k FROM hit) GROUP BY r),
names AS (SELECT r, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; mostly contaminated documents go. n_chars follows the text; that of a null text stays."""
    clean = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select([F.col(f"`{c}`") for c in docs.columns])
