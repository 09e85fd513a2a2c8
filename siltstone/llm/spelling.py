"""Spelling variants: frequent words that differ by one code point, and the common form that each leads to.

Words are the runs of letters of all texts, with their counts. Two words are near if one inserted, deleted or replaced
code point makes one of the other. That is so exactly if both lose one code point at the same place and become the same
string (replaced), or if one of them is the other without a code point.

How it scales
* Words are counted in Python a block of text at a time; each task gives out its counts whenever it holds many words, and
  Spark adds them up. A word in every document costs a row a task.
* A word's keys are polynomial hashes of the word and of the word without each of its code points, each one a prefix hash
  times a power plus a suffix hash: NumPy integers, for all words of a length at once. No string is cut.
* Keys are dealt by their leading bits, sorted, and only those that several words share go on. A string and a place in
  it are shared by no more words than there are letters, so there are no large groups, and no pairs are made: a group's
  counts and its two best words tell each member's.
* Only then do words meet their keys again. Groups are made anew by the strings themselves, so equal hashes of different
  strings change nothing.
* A form is at least ``ratio`` times as frequent as its word, so chains of forms are short; pointer jumping follows them
  in a few rounds.

Defined results: a null or empty text has no words; without a doc_id no code point is deleted; repeated rows count again
and again; equal counts go to the smaller word in code-point order; an empty table gives an empty result. Other columns
are never read. Invalid UTF-8 ends a word.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import forget, modest_batches, table, word_blocks, written

#: A run of letters, after A-Z have been lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Words that a task holds before it gives out their counts, and code points that it hashes at a time.
HELD, HASHED = 100_000, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def noised(word: str, head: int | None, noise: int) -> str:
    """``word`` without one code point, if ``noise`` divides the crc32 of its document's id, a colon and itself.

    ``head`` is the crc32 up to the word; null for a document without an id.
    """
    if head is None:
        return word
    h = zlib.crc32(word.encode(), head)
    at = h % len(word)
    return word if h % noise else word[:at] + word[at + 1 :]


def _counted(noise: int, shortest: int):
    def count(batches):
        import pyarrow as pa

        def rows(tally):
            return pa.record_batch([pa.array(tally.keys(), pa.string()), pa.array(tally.values(), pa.int64())], names=["word", "n"])

        tally: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                name = doc.as_py()
                head = None if name is None else zlib.crc32(f"{name}:".encode())
                for block in word_blocks((text.as_py() or b"").lower()):
                    for word, n in Counter(RUN.findall(block.decode("utf-8", "replace"))).items():
                        if len(word) >= shortest and len(word := noised(word, head, noise)) >= shortest:
                            tally[word] += n
                    if len(tally) > HELD:
                        yield rows(tally)
                        tally.clear()
        yield rows(tally)

    return count


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", noise: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of words of at least ``shortest`` code points that occur at least ``least`` times in all texts."""
    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string"), F.col(text).cast("binary"))
    counts = rows.mapInArrow(_counted(noise, shortest), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length L: keys of the words, keys (rows x L) without each code point, and whether that is the first of its run.

    Arithmetic is modulo 2 ** 64; equal strings have equal keys, whichever words they come from.
    """
    width = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, width)
    values = _mixed(points.astype(np.uint64) + np.uint64(1))
    powers = np.ones(width + 1, np.uint64)
    powers[1:] = np.cumprod(np.full(width, BASE, np.uint64), dtype=np.uint64)
    prefix, suffix = np.zeros((len(words), width + 1), np.uint64), np.zeros((len(words), width + 1), np.uint64)
    for i in range(width):
        prefix[:, i + 1] = prefix[:, i] * BASE + values[:, i]
        j = width - 1 - i
        suffix[:, j] = suffix[:, j + 1] + values[:, j] * powers[i]
    without = prefix[:, :-1] * powers[width - 1 :: -1] + suffix[:, 1:]
    first = np.ones(points.shape, bool)
    first[:, 1:] = points[:, 1:] != points[:, :-1]
    return _mixed(prefix[:, -1]), _mixed(without), first


def _keyed(batches):
    """(key, wid, pos, first): each word's own key at -1, and those without one code point."""
    import pyarrow as pa

    for batch in batches:
        wid, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for width, group in itertools.groupby(order, key=lambda i: len(words[i])):
            group, step = list(group), max(1, HASHED // width)
            for lo in range(0, len(group), step):
                some = group[lo : lo + step]
                whole, without, first = deletion_keys([words[i] for i in some])
                key = np.concatenate([whole[:, None], without], 1).view(np.int64)
                place = np.broadcast_to(np.arange(-1, width, dtype=np.int32), key.shape)
                firsts = np.concatenate([np.ones((len(some), 1), bool), first], 1)
                ids = np.broadcast_to(wid[some][:, None], key.shape)
                yield pa.record_batch([pa.array(x.ravel()) for x in (key, ids, place, firsts)], names=["key", "wid", "pos", "first"])


def _met(batches):
    """From rows sorted by key: those whose key several words have. Holds the last key's rows between batches."""
    import pyarrow as pa

    names, held = ["key", "wid", "pos", "first"], None

    def several(columns):
        key, wid = columns[0], columns[1]
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shared = np.minimum.reduceat(wid, start) != np.maximum.reduceat(wid, start)
        keep = np.repeat(shared, np.diff(np.append(start, len(key))))
        if keep.any():
            yield pa.record_batch([pa.array(c[keep]) for c in columns], names=names)

    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        yield from several([c[:last] for c in columns])
        held = [c[last:] for c in columns]
    if held is not None:
        yield from several(held)


def _shared_keys(words: DataFrame) -> DataFrame:
    """(key, wid, pos, first) of the keys that several words have."""
    keyed = words.select("wid", "word").mapInArrow(_keyed, "key long, wid long, pos int, first boolean")
    radix = F.shiftrightunsigned("key", 40)  # the leading bits: each of 2 ** 24 parts lies in one task
    return keyed.repartition(radix).sortWithinPartitions("key").mapInArrow(_met, "key long, wid long, pos int, first boolean")


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, best) of the stored words (wid, word, n) that have near words; best is the most frequent (neg, word)."""
    shared, place = _shared_keys(words), F.col("pos")
    left = F.when(place < 0, F.col("word")).otherwise(F.concat(F.expr("substr(word, 1, pos)"), F.expr("substr(word, pos + 2)")))
    rows = written(shared.join(words, "wid").select("wid", "n", "word", "pos", "first", left.alias("left")), "shared")
    own = F.struct((-F.col("n")).alias("neg"), "word")
    string, hole = Window.partitionBy("left"), Window.partitionBy("left", "pos")
    longer = (place >= 0) & F.col("first")
    rows = rows.withColumns({"whole": F.max(F.when(place < 0, own)).over(string), "longer": F.sum(F.when(longer, 1).otherwise(0)).over(string), "best_longer": F.min(F.when(longer, own)).over(string)})
    ranked = hole.orderBy(F.desc("n"), "word")
    rows = rows.withColumns({"others": F.count("*").over(hole) - 1, "top": F.first(own).over(ranked), "next": F.lead(own).over(ranked)})
    told = lambda n, best: F.struct(n.cast("long").alias("n_near"), best.alias("best"))
    inserted = F.when(place < 0, told(F.col("longer"), F.col("best_longer"))).when(longer & F.col("whole").isNotNull(), told(F.lit(1), F.col("whole")))
    replaced = F.when((place >= 0) & (F.col("others") > 0), told(F.col("others"), F.when(F.col("top")["word"] == F.col("word"), F.col("next")).otherwise(F.col("top"))))
    parts = rows.select("wid", F.explode(F.array(inserted, replaced)).alias("t")).filter("t.n_near > 0")
    return parts.groupBy("wid").agg(F.sum("t.n_near").alias("n_near"), F.min("t.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. Each round doubles the steps that are taken."""
    link = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = link.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if link.join(on, "root", "left_semi").isEmpty():
            return link
        old, link = link, written(link.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        forget(old)


def variants(docs: DataFrame, ratio: int = 5, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n of all frequent words; see ``word_counts`` for what else can be set.

    A form is the most frequent near word, if it is at least ``ratio`` (2 or more) times as frequent as the word itself.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its words, or chains have no end")
    words = written(word_counts(docs, **counting).withColumn("wid", F.monotonically_increasing_id()), "words")
    best = -F.col("best.neg")
    known = words.join(near_words(words), "wid", "left")
    has = best >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, best).alias("form_n"))
    known = written(known, "known")
    forget(words)
    out = known.join(roots(known.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark, sf_dir: str) -> DataFrame:
    """Words of at least six letters that occur five times or more in ``documents``, with their forms and roots."""
    return variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE crc_bits AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM crc_bits WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, (ord(c) - 64)::BIGINT] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM runs, crc_table),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word FROM cut a JOIN words w ON w.word = a.rest
  UNION SELECT w.word, a.word FROM cut a JOIN words w ON w.word = a.rest),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n
  FROM near JOIN words ON words.word = near.other GROUP BY near.word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
steps AS (
  SELECT word, word AS root, 0 AS k FROM formed
  UNION ALL SELECT steps.word, f.form, k + 1 FROM steps JOIN formed f ON f.word = steps.root WHERE f.form IS NOT NULL)
SELECT word, form, arg_max(root, k) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
FROM steps JOIN formed USING (word) GROUP BY word, form
"""
