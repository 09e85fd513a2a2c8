"""Language identification with word-first backoff.

A text's score for a language is the mean over its words of the word's log frequency there. A word that the lexicon
knows counts by its own frequency; any other falls back to its character n-grams, and each n-gram that is not known to
its longest known ending, shorter and shorter, down to single characters.

Learning counts words and n-grams of all labelled texts: each task merges its own counts before they are shuffled, and
Spark adds them up. An item is known if its share of a language's words (or of its n-grams of that length) is at least
``word_share`` (``gram_share``); words that stand once in all texts of a language are not. That rule is the same at any
size of the corpus and of the language, and it bounds the model: at most 1 / share items a language and kind, which is
what is broadcast. Everything else is what the backoff is for. Frequencies are out of all counts, known or not, with the
counts of a known item in all languages, and lean on the item's frequency over all languages, so that a language with
few texts is not favoured.

Defined results: null texts, and texts without a letter, are ``und`` with score 0; so is every text if nothing was
learned. Training rows without a language are ignored. A score is the posterior of the best language, ties going to the
alphabetically first. Repeated rows are each judged, extra columns stay (but the result takes the place of a column of
its name), an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import crc_fold, forget, modest_batches, private, table, with_results, written

ORDER = 4
#: Weight of an item's frequency over all languages in its frequency in one of them.
PRIOR = 20.0
WORD_SHARE, GRAM_SHARE = 1 / 1_000_000, 1 / 100_000
_HOLD = 200_000

#: Latin texts, all of whose letters are those of _LATIN (the blocks up to U+024F and general punctuation).
_SIMPLE = re.compile("[\x00-\u024f\u2000-\u206f]*")
_LATIN = re.compile("[a-zªµºß-öø-\u024f]+")


@functools.cache
def _find():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters (with their marks)."""
    if not text:
        return []
    low = text.lower()
    if low.isascii():  # the common cases, much faster
        return low.translate(_ASCII).split()
    return _LATIN.findall(low) if _SIMPLE.fullmatch(low) else _find()(low)


_ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


def grams_of(word: str) -> list[str]:
    """The n-grams of a word: for each of its characters the up to ORDER last ones, a space standing at either end."""
    padded = f" {word} "
    return [padded[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(padded))]


def _count(batches):
    """(lang, kind, item, n): kind 0 words, kind k n-grams of k characters; counts merged within the task."""
    import pyarrow as pa

    words: dict[str, Counter] = {}

    def flush():
        langs, kinds, items, ns = [], [], [], []
        for lang, counter in words.items():
            grams: Counter = Counter()
            for word, n in counter.items():
                for gram in grams_of(word):
                    grams[gram] += n
            ends: list[Counter] = [Counter() for _ in range(ORDER + 1)]
            for gram, n in grams.items():
                for k in range(1, len(gram) + 1):
                    ends[k][gram[-k:]] += n
            for kind, counts in enumerate([counter, *ends[1:]]):
                langs += [lang] * len(counts)
                kinds += [kind] * len(counts)
                items += counts.keys()
                ns += counts.values()
        words.clear()
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(items, pa.string()), pa.array(ns, pa.int64())], names=["lang", "kind", "item", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            words.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            if sum(map(len, words.values())) > _HOLD:
                yield flush()
    if words:
        yield flush()


@dataclass
class Model:
    """Log frequencies by language: words and n-grams by their row in ``table``; a missing item has none."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    unseen: float = -3.0

    def backoff(self, gram: str) -> np.ndarray:
        """Log frequencies of one n-gram: those of its longest known ending, and a constant a character before it."""
        for k in range(len(gram)):
            if (row := self.grams.get(gram[k:])) is not None:
                return self.table[row] + k * self.unseen
        return np.full(len(self.langs), len(gram) * self.unseen)


class Scorer:
    """Scores texts with a model and remembers, within bounds, words and n-grams that needed the backoff."""

    def __init__(self, model: Model):
        self.model, self.known = model, len(model.table)
        self.forget()

    def forget(self) -> None:
        self.others: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        self.table = np.concatenate([self.model.table, np.zeros((1 << 14, len(self.model.langs)))])
        self.of_grams = np.zeros((1 << 14, len(self.model.langs)))

    def _gram(self, gram: str) -> int:
        """The row of an n-gram that has not been met."""
        row = self.ends[gram] = len(self.ends)
        if row >= len(self.of_grams):
            self.of_grams = np.concatenate([self.of_grams, np.zeros_like(self.of_grams)])
        self.of_grams[row] = self.model.backoff(gram)
        return row

    def rows_of(self, words: list[str]) -> list[int]:
        """Rows of ``self.table`` for distinct words; adds those it has not met, all at once."""
        known, others, rows, fresh = self.model.words.get, self.others, [], []
        for w in words:
            if (row := known(w)) is None and (row := others.get(w)) is None:
                row = others[w] = self.known + len(others)
                fresh.append(w)
            rows.append(row)
        if fresh:
            get, grams, starts = self.ends.get, [], []
            for w in fresh:
                starts.append(len(grams))
                for g in grams_of(w):
                    grams.append(row if (row := get(g)) is not None else self._gram(g))
            end = self.known + len(others)
            while end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(self.table) - self.known, self.table.shape[1]))])
            self.table[end - len(fresh) : end] = np.add.reduceat(self.of_grams.take(grams, axis=0), starts, axis=0)
        return rows

    def score(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return "und", 0.0
        if len(self.others) + len(self.ends) > _HOLD:
            self.forget()
        counts = Counter(words)
        rows = self.rows_of(list(counts))
        mean = (np.fromiter(counts.values(), float, len(counts)) @ self.table.take(rows, axis=0)) / len(words)
        odds = np.exp((mean - mean.max()) * min(len(words), 20))  # neighbouring words are not independent evidence
        best = int(mean.argmax())
        return self.model.langs[best], float(odds[best] / odds.sum())


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE) -> Model:
    """The model of all rows of ``docs`` with a text and a language. Languages are taken to be far fewer than words."""
    modest_batches(docs.sparkSession)
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, kind int, item string, n long")
    counts = written(counted.repartition("kind", "item").groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")), "counts")
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    sums = {(r.lang, r.kind): r.total for r in totals.toLocalIterator()}
    langs = sorted({x for x, _ in sums})
    share = F.when(F.col("kind") == 0, word_share).otherwise(gram_share)
    enough = (F.col("n") >= share * F.col("total")) & ((F.col("kind") > 0) | (F.col("n") > 1))
    judged = counts.join(F.broadcast(totals), ["lang", "kind"]).withColumn("enough", enough)  # ORDER + 1 rows a language
    known = judged.groupBy("kind", "item").agg(F.max("enough").alias("enough"), F.collect_list(F.struct("lang", "n")).alias("ns")).filter("enough")
    place = {x: i for i, x in enumerate(langs)}
    size = np.array([[sums.get((x, k), 0) for x in langs] for k in range(ORDER + 1)], float).reshape(ORDER + 1, len(langs))
    words, grams, parts, at = {}, {}, [np.zeros((0, len(langs)))], 0
    for kind in range(ORDER + 1):
        found = known.filter(F.col("kind") == kind).select("item", "ns").toArrow()  # at most 1 / share rows a language
        items, ns = found.column("item").to_pylist(), found.column("ns").combine_chunks()
        if not items:
            continue
        of = np.repeat(np.arange(len(items)), ns.value_lengths().to_numpy())
        flat = ns.flatten()
        own = np.zeros((len(items), len(langs)))
        own[of, [place[x] for x in flat.field("lang").to_pylist()]] = flat.field("n").to_numpy()
        parts.append(np.log((own + PRIOR * own.sum(axis=1, keepdims=True) / size[kind].sum()) / (size[kind] + PRIOR)))
        (grams if kind else words).update(zip(items, range(at, at + len(items)), strict=True))
        at += len(items)
    forget(counts)
    return Model(langs, words, grams, np.concatenate(parts))


_scorers: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "lang_id") -> DataFrame:
    """``docs`` with a struct of lang_pred and score."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 1 / WORD_SHARE + ORDER / GRAM_SHARE items a language
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    name = f"{id(model)}-{shared._jbroadcast.id()}"

    @F.arrow_udf(kind)
    def predicted(texts):
        import pyarrow as pa

        from siltstone.llm import langid as own  # by name, so that what a worker remembers outlives the task

        scorer = own._scorers.get(name)
        if scorer is None:
            own._scorers.clear()
            scorer = own._scorers[name] = own.Scorer(shared.value)
        out = [scorer.score(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["lang_pred", "score"])

    return docs.select(with_results(docs, docs.columns, {into: predicted(F.col(text))}))


def op4_language(spark, sf_dir: str) -> DataFrame:
    """The language of every text, by a model of the texts whose crc32(doc_id) mod 4 is not 2; rows without an id teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_fold("doc_id", 4)
    model = learn(docs.filter(fold != 2))
    (found,) = private(docs, "found")
    out = predict(docs.select("doc_id", "text"), model, into=found)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), f"{found}.lang_pred", f"{found}.score")
