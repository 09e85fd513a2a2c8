"""Tokenises documents and packs them into sequences of at most ``capacity`` tokens.

Documents longer than the capacity are cut in pieces; nothing else is. Pieces that fill a sequence stand alone. All
others are dealt at random in groups of bounded size, and each group is packed by itself: best fit first, then local
search between the underfull bins, which moves one document, exchanges one for one or two for one whenever that
raises the sum of squared fills, until the emptiest bins are empty. The bins that a group leaves clearly underfull are
opened, and their pieces are dealt and packed again with those of other groups; the last such round has few rows.

A tokenizer that lower-cases and splits at white space and words, as the vocabulary file itself says, never joins over
those borders, so a text's ids are those of its words, one after another; each task keeps the ids of words it has seen,
and only new ones reach the BPE. With any other vocabulary whole texts go to the tokenizer.

``local_search`` tries at most 64 fuller bins a step: a bound on the effort, no piece is ever left out.

Defined results: null text counts as empty and gives the end id alone. Repeated rows are packed one by one, rows
without a doc_id too. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import modest_batches, table, written

CAPACITY = 4096
#: Vocabulary files above this many bytes are refused, for they are broadcast.
MOST_VOCABULARY = 64 << 20
#: Chunks, and words, that a task remembers of late and of before, and the longest of them.
MOST_CHUNKS, MOST_WORDS, LONGEST = 50_000, 200_000, 64

#: White space to Python's str.split(), but perhaps not to the tokenizer: such texts go to the tokenizer whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The tokenizer's own split, for plain texts in lower case, the most frequent kind first.
_SPLIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9ß-öø-ÿ]+")


#: What the vocabulary file says of texts that can be encoded word by word.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(vocabulary: str) -> bool:
    """Whether a vocabulary file's tokenizer encodes words one by one, as ``ChunkEncoder`` does."""
    said = json.loads(vocabulary)
    special = all("<|" in t["content"] for t in said.get("added_tokens") or [])
    return special and said.get("normalizer") == _NORMALIZER and said.get("pre_tokenizer") == _PRE_TOKENIZER and said["model"]["type"] == "BPE" and not said.get("post_processor")


def _byte_letters() -> dict[int, str]:
    """Byte to the visible character that byte-level BPE writes for it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """``encode(text)`` gives the ids as little-endian 32-bit bytes, equal to the tokenizer's on the whole text.

    Plain texts are split into words as the tokenizer does, and words are remembered; of other texts the white-space
    chunks are. Both are kept in two generations: when the young one is full it becomes the old one, which is dropped.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.split = by_words(vocabulary)
        self.letters = _byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def of_words(self, words: list[str]) -> bytes:
        if len(self.words) > MOST_WORDS:
            self.old_words, self.words = self.words, {}
        known, old, packed, tokenize = self.words, self.old_words, self.packed, self.tokenizer.model.tokenize
        long = {}
        for word in set(words).difference(known):
            ids = old.get(word)
            if ids is None:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = b"".join([packed[t.id] for t in tokenize(spelled)])
            (known if len(word) <= LONGEST else long)[word] = ids
        return b"".join([long[w] if w in long else known[w] for w in words] if long else map(known.__getitem__, words))

    def chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not _PLAIN.fullmatch(chunk):
            return self.whole(chunk)
        return self.of_words(_SPLIT.findall(chunk.lower()))

    def encode(self, text: str) -> bytes:
        if not self.split:
            return self.whole(text)
        if "<|" not in text and _PLAIN.fullmatch(text):
            return self.of_words(_SPLIT.findall(text.lower()))
        if _ODD_SPACE.search(text):
            return self.whole(text)
        if len(self.chunks) > MOST_CHUNKS:
            self.old_chunks, self.chunks = self.chunks, {}
        chunks, known, long = text.split(), self.chunks, {}
        for c in set(chunks).difference(known):
            ids = self.old_chunks.get(c)
            (known if len(c) <= LONGEST else long)[c] = self.chunk(c) if ids is None else ids
        return b"".join([long[c] if c in long else known[c] for c in chunks] if long else map(known.__getitem__, chunks))


def _cut(vocabulary, end_id: int, capacity: int, keep_ids: bool):
    def cut(batches):
        import numpy as np
        import pyarrow as pa

        encoder = ChunkEncoder(vocabulary.value)  # a task's own: idle workers hold no memory
        end, step = end_id.to_bytes(4, "little"), 4 * capacity

        def rows(batch, parts):
            of, piece, start, length, crc, ids = zip(*parts, strict=True)
            keys = batch.column(0).take(pa.array(of, pa.int32()))
            columns = [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
            return pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

        for batch in batches:
            parts, held = [], 0
            for k, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for p, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    parts.append((k, p, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else b""))
                held += len(ids) if keep_ids else 0
                if held > 8 << 20:
                    yield rows(batch, parts)
                    parts, held = [], 0
            if parts:
                yield rows(batch, parts)

    return cut


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if kept) of every piece of ``docs`` (doc_id, text)."""
    modest_batches(docs.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read(MOST_VOCABULARY + 1)
    if len(vocabulary) > MOST_VOCABULARY:
        raise ValueError("the vocabulary file is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType())])
    for name in ("start", "length", "ids_crc32"):
        schema.add(name, T.LongType())
    if keep_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select("doc_id", "text").mapInArrow(_cut(shared, end_id, capacity, keep_ids), schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        left = room - n
        if left:
            by_room.setdefault(left, []).append(k)
            rooms |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, tries: int = 64) -> list[list[int]]:
    """Raises the sum of squared fills between underfull bins until the emptiest can give nothing more.

    The emptiest bin gives; up to ``tries`` fuller bins, fullest first, take: a document that fits, or one in exchange
    for a shorter one, or one in exchange for two that are shorter together. Every step moves tokens to a fuller bin,
    so the search ends.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    given_up: set[int] = set()
    while True:
        under = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity and k not in given_up), key=lambda k: fill[k])
        if len(under) < 2:
            return [b for b in bins if b]
        source, changed = under[0], False
        for k in under[:0:-1][:tries]:
            if fill[k] < fill[source] or not bins[source]:
                continue
            room = capacity - fill[k]
            best = (0, (), ())
            own = sorted(bins[source], key=lambda i: -lengths[i])
            here = sorted(bins[k], key=lambda i: lengths[i])
            for d in own:
                n = lengths[d]
                if best[0] < n <= room:
                    best = (n, (d,), ())
                for a, e in enumerate(here):
                    gain = n - lengths[e]
                    if gain <= best[0]:
                        break
                    if gain <= room:
                        best = (gain, (d,), (e,))
                    for e2 in here[a + 1 :]:
                        both = gain - lengths[e2]
                        if both <= best[0]:
                            break
                        if both <= room:
                            best = (both, (d,), (e, e2))
                if best[0] == room:
                    break
            gain, out, back = best
            if gain:
                bins[source] = [i for i in bins[source] if i not in out] + list(back)
                bins[k] = [i for i in bins[k] if i not in back] + list(out)
                fill[source] -= gain
                fill[k] += gain
                changed = True
        if not changed:
            given_up.add(source)


def _pack(capacity: int, round_: int, rounds: int):
    def pack(group):
        import numpy as np
        import pyarrow as pa

        order = sorted(range(group.num_rows), key=list(zip(*(group.column(c).to_pylist() for c in ("row", "piece")), strict=True)).__getitem__)
        group = group.take(pa.array(order, pa.int64()))  # the same bins however the rows arrive
        lengths = group.column("length").to_pylist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        first = (group.column("group")[0].as_py() * rounds + round_) << 20
        sequence, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(bins):
            own = [lengths[i] for i in b]
            sequence[b], offset[b], fill[b] = first + k, np.cumsum([0, *own[:-1]]), sum(own)
        for name, values in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
            group = group.append_column(name, pa.array(values))
        return group.drop_columns(["group"])

    return pack


def pack(parts: DataFrame, capacity: int = CAPACITY, group_rows: int = 4096, open_below: float = 0.97) -> DataFrame:
    """Adds sequence_id and offset to pieces (piece, length and any other columns), in two rounds.

    ``parts`` must be a stored table: its row numbers deal the groups.
    """
    names = parts.columns
    parts = parts.withColumn("row", F.monotonically_increasing_id())
    whole = parts.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    rest, done = parts.filter(F.col("length") < capacity), [whole.select(*names, "sequence_id", "offset")]
    rounds = 2
    for k in range(rounds):
        groups = max(1, -(-rest.count() // group_rows))
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
        schema = T.StructType([f for f in rest.schema.fields] + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "fill")])
        packed = dealt.groupBy("group").applyInArrow(_pack(capacity, k, rounds), schema)
        if k == rounds - 1:
            done.append(packed.select(*names, "sequence_id", "offset"))
            break
        packed = written(packed, "packed")
        loose = F.col("fill") < open_below * capacity
        done.append(packed.filter(~loose).select(*names, "sequence_id", "offset"))
        rest = packed.filter(loose).drop("sequence_id", "offset", "fill")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def best_fit_packing(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their place: sequence_id and offset."""
    return pack(written(pieces(docs, vocabulary_path, capacity, end_id, keep_ids), "pieces"), capacity)


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return best_fit_packing(table(spark, sf_dir, "documents"), _vocabulary())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what the stages before have kept: pieces and places, not documents."""
    return best_fit_packing(docs, _vocabulary())
