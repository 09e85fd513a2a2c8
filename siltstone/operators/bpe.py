"""Byte-level BPE of its own: training on a table of word counts, encoding by ranks, decoding by a byte table.

Training
* Texts are cut into pre-tokens by column functions (a digit alone; letters, or other signs, with the space before them;
  white space) and counted. Only this table of distinct words takes part in what follows; no text reaches the driver.
* Each round counts adjacent pairs over all words, and takes those above a threshold, as many as ``candidates``. Words are
  cut into their segments of such pairs, equal segments are summed, and the driver merges on the segments alone, one pair
  at a time, until no pair is above the threshold. These are the merges of the whole table: however a pair that is above
  it came about, its two inner neighbours were an adjacent pair that is at least as frequent, so all its occurrences lie
  within segments. A threshold whose segments hold more than ``most_symbols`` symbols is raised, so what the driver holds
  is bounded whatever the table's size.
* Where even the most frequent pairs alone are too many (ties at a low count), a part of them is taken at once: the
  longest beginning of their order in which no pair ends with the first, or begins with the second, symbol of one before
  it, up to a pair of equal symbols. Such merges do not touch each other, and what they create comes later in the order.
* Then the words that hold a merge are rewritten, each by its merges in their order, and words of one symbol leave.

So the merges equal those of a plain sequential trainer: the most frequent pair each time, ties to the smaller ids. Each
round is written to the shared folder; its number follows from the vocabulary's size and not from the data's.

Encoding merges each pre-token's symbols by rank, with linked symbols and a heap; words are remembered up to a bound.

Defined results: null and empty texts have no words and no ids; ids of specials never come out of text; an empty table
has no merges; the vocabulary may come out smaller than asked for.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import batches_of, forgotten, modest_batches, stored
from .chat import SPECIAL_TOKENS

#: White space, to Unicode, and the pre-tokens. Fixed values of byte-level BPE; digits stand alone, so white space before one is whole.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+|\p{{N}}| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}\p{{N}}])|[{SPACE}]+"
#: Bytes that stand for themselves as printable characters; the others are shown as characters from U+0100 on, in order.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_ORDER = PRINTABLE + sorted(set(range(256)) - set(PRINTABLE))
FIRST_MERGE = len(SPECIAL_TOKENS) + 256
REMEMBERED = 1 << 17

_ID_OF_BYTE = np.zeros(256, np.int32)
_ID_OF_BYTE[BYTE_ORDER] = np.arange(256) + len(SPECIAL_TOKENS)


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all pre-tokens."""
    return docs.select(F.explode(pre_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def symbols_of(word: str) -> list[int]:
    return _ID_OF_BYTE[np.frombuffer(word.encode("utf-8", "replace"), np.uint8)].tolist()


def _code(left: int, right: int) -> int:
    return left << 32 | right


def merged(symbols: list[int], ranks: dict[int, int]) -> list[int]:
    """``symbols`` after all merges: ``ranks`` has the new id of each pair (as a code), and smaller ids merge first."""
    n = len(symbols)
    heap = [(ranks[c], i, c) for i in range(n - 1) if (c := _code(symbols[i], symbols[i + 1])) in ranks]
    if not heap:
        return symbols
    heapq.heapify(heap)
    symbols, after, before = [*symbols, -1], list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        new, i, code = heapq.heappop(heap)
        j = after[i] if symbols[i] >= 0 else n
        if j >= n or _code(symbols[i], symbols[j]) != code:
            continue  # one of the two has merged otherwise
        symbols[i], symbols[j], after[i] = new, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (c := _code(new, symbols[after[i]])) in ranks:
                heapq.heappush(heap, (ranks[c], i, c))
        if before[i] >= 0 and (c := _code(symbols[before[i]], new)) in ranks:
            heapq.heappush(heap, (ranks[c], before[i], c))
    return [s for s in symbols if s >= 0]


@dataclass(frozen=True)
class Model:
    """Merges in order: pairs of ids and how often each was there. The i-th makes the id ``FIRST_MERGE`` + i."""

    merges: tuple[tuple[int, int, int], ...]

    def get_vocab_size(self) -> int:
        return FIRST_MERGE + len(self.merges)

    def token_to_id(self, token: str) -> int | None:
        return self.vocabulary().get(token)

    def ranks(self) -> dict[int, int]:
        return {_code(a, b): FIRST_MERGE + i for i, (a, b, _) in enumerate(self.merges)}

    def byte_table(self) -> list[bytes]:
        """What each id stands for."""
        out = [t.encode() for t in SPECIAL_TOKENS] + [bytes([b]) for b in BYTE_ORDER]
        for a, b, _ in self.merges:
            out.append(out[a] + out[b])
        return out

    def vocabulary(self) -> dict[str, int]:
        """Ids by token, bytes shown as characters."""
        shown = {b: chr(b) for b in PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(BYTE_ORDER[len(PRINTABLE) :])}
        own = [*SPECIAL_TOKENS, *("".join(shown[x] for x in b) for b in self.byte_table()[len(SPECIAL_TOKENS) :])]
        return {t: i for i, t in enumerate(own)}

    def to_str(self) -> str:
        """The tokenizer in the public JSON format of the ``tokenizers`` library."""
        vocabulary = self.vocabulary()
        names = list(vocabulary)
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}
        added = [{"id": i, "content": t, "special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False} for i, t in enumerate(SPECIAL_TOKENS)]
        model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocabulary, "merges": [[names[a], names[b]] for a, b, _ in self.merges]}
        steps = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, byte_level]}
        return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": steps, "post_processor": byte_level, "decoder": byte_level, "model": model}, ensure_ascii=False)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_str())

    @classmethod
    def load(cls, path: str) -> Model:
        """A model from that format. How often pairs were there is not in it, so that is 0."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        out = cls(tuple((ids[a], ids[b], 0) for a, b in pairs))
        if out.vocabulary() != ids:
            raise ValueError(f"{path} is not a byte-level tokenizer with the special tokens first")
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """(rank, left, right, token, n), a row a merge; the tokens' bytes in hexadecimal digits."""
        table = self.byte_table()
        rows = [(i, table[a].hex(), table[b].hex(), table[FIRST_MERGE + i].hex(), n) for i, (a, b, n) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left string, right string, token string, n long")


def _spread(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (symbols, n): all symbols, each word's end, the codes of adjacent pairs within words, and their left places."""
    lists = batch.column(0)
    flat = np.asarray(lists.flatten()).astype(np.int64)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    inside = np.ones(max(0, len(flat) - 1), bool)
    inside[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(flat))] - 1] = False
    left = np.flatnonzero(inside)
    return flat, ends, flat[left] << 32 | flat[left + 1], left


def _pair_sums(batches):
    import pyarrow as pa

    for batch in batches:
        _, ends, codes, left = _spread(batch)
        own, at = np.unique(codes, return_inverse=True)
        sums = np.zeros(len(own), np.int64)
        np.add.at(sums, at, batch.column(1).to_numpy()[np.searchsorted(ends, left, "right")])
        yield pa.record_batch([pa.array(own), pa.array(sums)], names=["pair", "n"])


def _segments(pairs):
    """(symbols, n): the longest pieces of words in which every adjacent pair is one of ``pairs``."""

    def cut(batches):
        import pyarrow as pa

        wanted = pairs.value
        for batch in batches:
            flat, ends, codes, left = _spread(batch)
            at = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
            joins = np.zeros(len(flat) + 1, bool)
            joins[left[wanted[at] == codes] + 1] = True  # whether a symbol goes with the one before it
            if not joins.any():
                continue
            begin = np.flatnonzero(~joins[:-1] & joins[1:])
            end = np.flatnonzero(joins[:-1] & ~joins[1:]) + 1
            n = batch.column(1).to_numpy()[np.searchsorted(ends, begin, "right")]
            sizes = end - begin
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            symbols = flat[np.repeat(begin - offsets[:-1], sizes) + np.arange(offsets[-1])].astype(np.int32)
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(offsets), pa.array(symbols)), pa.array(n)], names=["symbols", "n"])

    return cut


def _rewritten(shared):
    """The words after the merges ``shared`` (sorted codes and new ids); those of one symbol are left out."""

    def rewrite(batches):
        import pyarrow as pa

        codes, ids = shared.value
        ranks = dict(zip(codes.tolist(), ids.tolist(), strict=True))
        for batch in batches:
            _, ends, own, left = _spread(batch)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            holds = np.unique(np.searchsorted(ends, left[codes[at] == own], "right"))
            keep = np.ones(len(ends), bool)
            keep[holds] = False
            done = [(w, n) for w, n in zip((merged(w, ranks) for w in batch.column(0).take(pa.array(holds)).to_pylist()), batch.column(1).to_numpy()[holds].tolist(), strict=True) if len(w) > 1]
            if keep.any():
                yield batch.filter(pa.array(keep))
            if done:
                yield pa.record_batch([pa.array([w for w, _ in done], batch.schema.field(0).type), pa.array([n for _, n in done], pa.int64())], names=["symbols", "n"])

    return rewrite


def sequential(words: Iterable[tuple[list[int], int]], new_id: int, room: int, least: int) -> list[tuple[int, int, int]]:
    """Up to ``room`` merges (left, right, count) of pairs that occur ``least`` times or more, the most frequent each time."""
    held = [(list(w), n) for w, n in words]
    counts: dict[int, int] = defaultdict(int)
    where: dict[int, set[int]] = defaultdict(set)
    for k, (w, n) in enumerate(held):
        for c in map(_code, w, w[1:]):
            counts[c] += n
            where[c].add(k)
    heap = [(-n, c) for c, n in counts.items()]
    heapq.heapify(heap)
    out: list[tuple[int, int, int]] = []
    while heap and len(out) < room:
        n, code = heapq.heappop(heap)
        if -n != counts[code]:
            if counts[code] > 0:
                heapq.heappush(heap, (-counts[code], code))
            continue
        if -n < least:
            break
        out.append((code >> 32, code & 0xFFFFFFFF, -n))
        changed = set()
        for k in where.pop(code):
            w, times = held[k]
            for c in map(_code, w, w[1:]):
                counts[c] -= times
            w = merged(w, {code: new_id})
            held[k] = w, times
            for c in map(_code, w, w[1:]):
                counts[c] += times
                where[c].add(k)
                changed.add(c)
        counts[code] = 0
        for c in changed:
            if c >> 32 == new_id or c & 0xFFFFFFFF == new_id:
                heapq.heappush(heap, (-counts[c], c))
        new_id += 1
    return out


def independent(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The longest beginning of pairs (code, count), sorted by falling count and rising code, that merge without touching."""
    firsts, seconds, out = set(), set(), []
    for code, n in pairs:
        a, b = code >> 32, code & 0xFFFFFFFF
        if b in firsts or a in seconds:
            break
        out.append((a, b, n))
        if a == b:
            break
        firsts.add(a)
        seconds.add(b)
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _symbols(words):
    import pyarrow as pa

    return pa.array([symbols_of(w.as_py()) for w in words], pa.list_(pa.int32()))


def train(counts: DataFrame, vocab_size: int = 32_768, min_frequency: int = 2, candidates: int = 4_096, most_symbols: int = 2_000_000) -> Model:
    """The model of words and their counts (word, n), as in ``word_counts``."""
    if not 256 <= vocab_size <= 65_535:
        raise ValueError("the vocabulary must have 256 to 65535 tokens")
    with batches_of(counts.sparkSession, 10_000):  # rows here are words, however modest the session's batches of texts
        return _trained(counts, vocab_size, min_frequency, candidates, most_symbols)


def _trained(counts: DataFrame, vocab_size: int, min_frequency: int, candidates: int, most_symbols: int) -> Model:
    share = counts.sparkSession.sparkContext.broadcast
    least, most, merges = max(1, min_frequency), candidates, []
    symbols = _symbols.asNondeterministic()  # else the filter below moves it before the count, where it runs on every occurrence
    words = stored(counts.select(symbols("word").alias("symbols"), F.col("n").cast("long").alias("n")).filter(F.size("symbols") > 1), "words")
    while (room := vocab_size - FIRST_MERGE - len(merges)) > 0:
        sums = words.mapInArrow(_pair_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = [(r.pair, r.n) for r in sums.filter(F.col("n") >= least).orderBy(F.desc("n"), "pair").limit(candidates + 1).collect()]
        if not top:
            break
        some, every = min(len(top), most + 1), len(top) <= most
        fresh = None
        while fresh is None:
            bar = least if every else top[some - 1][1] + 1  # all pairs from here on are in ``top``
            wanted = [c for c, n in top if n >= bar]
            if not wanted:  # more ties than can be told apart
                fresh = independent([x for x in top[:candidates] if x[1] == top[0][1]])[:room]
                break
            pairs = share(np.sort(np.array(wanted, np.int64)))
            pieces = stored(words.mapInArrow(_segments(pairs), words.schema).groupBy("symbols").agg(F.sum("n").alias("n")), "segments")
            if (pieces.agg(F.sum(F.size("symbols"))).first()[0] or 0) <= most_symbols:
                fresh = sequential(((r.symbols, r.n) for r in pieces.toLocalIterator()), FIRST_MERGE + len(merges), room, bar)
                most = min(candidates, 2 * len(wanted))  # about as many will do in the next round
            else:
                some, every = max(1, len(wanted) // 2), False
            forgotten(pieces)
        order = sorted((_code(a, b), FIRST_MERGE + len(merges) + i) for i, (a, b, _) in enumerate(fresh))
        merges += fresh
        table = share((np.array([c for c, _ in order], np.int64), np.array([i for _, i in order], np.int64)))
        old, words = words, stored(words.mapInArrow(_rewritten(table), words.schema), "words")
        forgotten(old)
    forgotten(words)
    return Model(tuple(merges))


def encode(docs: DataFrame, model: Model, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text."""
    modest_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(model.ranks())  # at most 65,535 pairs
    known: dict[str, list[int]] = {}

    def ids_of(words) -> list[int]:
        out: list[int] = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = merged(symbols_of(word), ranks.value)
                if len(word) <= 32:
                    known[word] = ids
            out += ids
        return out

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts):
        import pyarrow as pa

        return pa.array([ids_of(w.as_py() or ()) for w in texts], pa.list_(pa.int32()))

    return docs.withColumn(into, encoded.asNondeterministic()(pre_tokens(F.col(text))))  # else a filter would compute it twice


def decode(ids: Column, model: Model) -> Column:
    """The text of ids, by a table of each id's bytes; what is not UTF-8 becomes U+FFFD."""
    table = F.from_json(F.lit(json.dumps([b.hex() for b in model.byte_table()])), "array<string>")  # folded to one literal
    return F.make_valid_utf8(F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")).cast("string"))
