"""Token streams: encoding, budgets, windows, loss masks, padding.

A stream is rows of (ord, ids). Positions in it come from per-partition sums and their offsets, so no task sees all
rows. The learned tokenizer is that of ``bpe``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import modest_batches, stored
from . import bpe
from .chat import SPECIAL_TOKENS, message

PAD, BOS, EOS, IGNORE = 0, 1, 2, -100


def byte_ids(text: Column) -> Column:
    """Ids of a byte tokenizer: each UTF-8 byte, after the special tokens."""
    hexed = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.transform(hexed, lambda h: F.conv(h, 16, 10).cast("int") + len(SPECIAL_TOKENS))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _byte_stream(texts):
    import numpy as np
    import pyarrow as pa

    rows = [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8) for x in texts]
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    ids = np.concatenate([np.zeros(0, np.uint8), *rows]).astype(np.int32) + len(SPECIAL_TOKENS)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=pa.array([not x.is_valid for x in texts]))


def byte_stream(text: Column) -> Column:
    """The same as ``byte_ids`` for a column outside lambdas, made by the batch."""
    return _byte_stream(text)


def train_bpe(docs: DataFrame, vocab_size: int = 32_768, min_frequency: int = 2, text: str = "text") -> bpe.Model:
    """A byte-level BPE model of all texts: the special tokens first, digits alone."""
    if not 256 <= vocab_size <= 65_535:
        raise ValueError("the vocabulary must have 256 to 65535 tokens")
    return bpe.train(bpe.word_counts(docs, text), vocab_size, min_frequency)


def encode(docs: DataFrame, model: bpe.Model, text: str = "text", into: str = "ids", eos: bool = True) -> DataFrame:
    """``docs`` with ids, an end token after each text; texts without a token are dropped."""
    out = bpe.encode(docs, model, text, into).filter(F.size(into) > 0)
    return out.withColumn(into, F.concat(into, F.array(F.lit(EOS)))) if eos else out


def encode_conversation(messages: DataFrame, encode_text, column: str = "messages", mask_prompt: bool = True) -> DataFrame:
    """Adds ids and labels. Each turn is encoded alone; role tokens, bos and eos never count, an assistant's text and its end do.

    ``encode_text`` maps a column of contents to arrays of ids.
    """
    ids = {t: i for i, t in enumerate(SPECIAL_TOKENS)}
    role = lambda m: F.when(m["role"] == "system", ids["<|system|>"]).when(m["role"] == "user", ids["<|user|>"]).otherwise(ids["<|assistant|>"])
    turns = F.transform(column, lambda m: F.struct(F.concat(F.array(role(m)), encode_text(m["content"]), F.array(F.lit(ids["<|end|>"]))).alias("ids"), ((m["role"] == "assistant") | F.lit(not mask_prompt)).alias("own")))
    wrap = lambda middle, a, b: F.concat(F.array(F.lit(a)), F.flatten(middle), F.array(F.lit(b)))
    labels = F.transform("_turns", lambda x: F.transform(x["ids"], lambda i, k: F.when(x["own"] & (k > 0), i).otherwise(IGNORE)))
    out = messages.withColumn("_turns", turns)
    return out.withColumns({"ids": wrap(F.transform("_turns", lambda x: x["ids"]), BOS, EOS), "labels": wrap(labels, IGNORE, IGNORE)}).drop("_turns")


def usable_examples(examples: DataFrame, max_len: int) -> DataFrame:
    """Examples that fit and supervise something; nothing is truncated."""
    return examples.filter((F.size("ids") <= max_len) & F.exists("labels", lambda x: x != IGNORE))


def encode_pairs(pairs: DataFrame, encode_text, max_len: int, mask_prompt: bool = True) -> DataFrame:
    """Preference pairs (prompt, chosen, rejected) with chosen_ids, chosen_labels, rejected_ids and rejected_labels.

    Either answer is encoded as a conversation of its own; a pair of which one side is longer than ``max_len`` goes.
    """
    out = pairs
    for side in ("chosen", "rejected"):
        turns = F.array(message(F.lit("user"), F.col("prompt")), message(F.lit("assistant"), F.col(side)))
        encoded = encode_conversation(out.withColumn("_messages", turns), encode_text, "_messages", mask_prompt)
        out = encoded.drop("_messages").withColumnsRenamed({"ids": f"{side}_ids", "labels": f"{side}_labels"})
    return out.filter((F.size("chosen_ids") <= max_len) & (F.size("rejected_ids") <= max_len))


def with_offsets(stream: DataFrame, order: str = "ord", length: Column | None = None) -> DataFrame:
    """``stream`` with start: the tokens before the row, in order."""
    modest_batches(stream.sparkSession)
    n = F.size("ids").cast("long") if length is None else length
    rows = stored(stream.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_n": n, "_part": F.spark_partition_id()}), "stream")
    sums = rows.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row a partition
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return rows.withColumn("_inside", inside).join(before, "_part").withColumn("start", F.col("_inside") + F.col("_before")).drop("_n", "_part", "_inside", "_before")


def val_budget_split(stream: DataFrame, val_tokens: int, order: str = "ord") -> DataFrame:
    """is_val for documents in order until the budget is reached; the first always, the one that crosses it too."""
    return with_offsets(stream, order).withColumn("is_val", (F.col("start") < val_tokens) | (F.col("start") == 0))


def slices(placed: DataFrame, width: int, more: int) -> DataFrame:
    """(win, at, ids): the part of each row that lies in window ``win``, which has ``more`` tokens beyond its ``width``."""
    start, n = F.col("start"), F.size("ids").cast("long")
    first, last = F.greatest(F.floor((start - more) / width), F.lit(0)), F.floor((start + n - 1) / width)

    def part(win):
        at = F.greatest(start, win * width)
        return F.struct(win.alias("win"), at.alias("at"), F.slice("ids", (at - start + 1).cast("int"), (F.least(start + n, win * width + width + more) - at).cast("int")).alias("ids"))

    return placed.filter(n > 0).select(F.explode(F.transform(F.sequence(first, last), part)).alias("p")).select("p.*")


def pack_windows(stream: DataFrame, width: int, order: str = "ord", most: int | None = None) -> DataFrame:
    """Windows (win, x, y) of the concatenated stream: x at stride ``width``, y shifted by one; the tail is dropped.

    Rows are cut at the windows' borders, so what is shuffled is slices, about as many as windows and rows together.
    """
    parts = slices(with_offsets(stream, order), width, 1)
    if most is not None:
        parts = parts.filter(F.col("win") < most)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda p: p["ids"]))
    rows = parts.groupBy("win").agg(whole.alias("t")).filter(F.size("t") == width + 1)
    return rows.select("win", F.slice("t", 1, width).alias("x"), F.slice("t", 2, width).alias("y"))


def pad_collate(examples: DataFrame, batch_size: int, order: str = "ord") -> DataFrame:
    """(batch, ord, x, y): right-padded to the batch's longest, x without the last token, y without the first."""
    from .dedupe import numbered

    rows = numbered(examples, [order]).withColumn("batch", F.floor(F.col("rn") / batch_size)).drop("rn")
    return _padded(rows, order, "ids", "labels")


def pair_collate(pairs: DataFrame, batch_size: int, order: str = "ord") -> DataFrame:
    """(batch, ord, chosen_x, chosen_y, rejected_x, rejected_y): each side of a batch is padded to its own longest."""
    from .dedupe import numbered

    rows = stored(numbered(pairs, [order]).withColumn("batch", F.floor(F.col("rn") / batch_size)).drop("rn"), "pairs")
    chosen, rejected = (_padded(rows, order, f"{s}_ids", f"{s}_labels").withColumnsRenamed({"x": f"{s}_x", "y": f"{s}_y"}) for s in ("chosen", "rejected"))
    return chosen.join(rejected, ["batch", order])


def _padded(rows: DataFrame, order: str, ids: str, labels: str) -> DataFrame:
    """(batch, ord, x, y) of rows with a batch."""
    rows = rows.select("batch", order, F.col(ids).alias("ids"), F.col(labels).alias("labels"))
    width = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    padded = lambda c, by: F.concat(F.col(c), F.array_repeat(F.lit(by), F.col("_w") - F.size(c)))
    out = rows.withColumn("_w", width).select("batch", order, padded("ids", PAD).alias("ids"), padded("labels", IGNORE).alias("labels"), "_w")
    return out.select("batch", order, F.slice("ids", F.lit(1), F.col("_w") - 1).alias("x"), F.slice("labels", F.lit(2), F.col("_w") - 1).alias("y"))


def random_windows(stream: DataFrame, width: int, n: int, seed: int = 0, order: str = "ord") -> DataFrame:
    """``n`` windows (draw, x, y) at offsets drawn from a hash of the seed, below the last full one."""
    total = stream.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    if total <= width + 1:
        raise ValueError("the stream is shorter than a window")
    spark = stream.sparkSession
    draws = spark.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total - width - 1)).alias("from"))
    blocks = draws.select("draw", "from", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("from") + width) / width))).alias("block"))
    met = slices(with_offsets(stream, order), width, 0).withColumnRenamed("win", "block").join(blocks, "block")
    parts = F.array_sort(F.collect_list(F.struct("at", "ids")))
    ids = F.slice(F.flatten(F.transform(parts, lambda p: p["ids"])), (F.first("from") - F.min("at") + 1).cast("int"), F.lit(width + 1))
    return met.groupBy("draw").agg(ids.alias("t")).select("draw", F.slice("t", 1, width).alias("x"), F.slice("t", 2, width).alias("y"))


def compression_ratio(docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
    """Characters a token; 0 without tokens."""
    sums = docs.agg(F.sum(F.length(text)).alias("chars"), F.sum(F.size(ids).cast("long")).alias("tokens"))
    return sums.select(F.coalesce(F.when(F.col("tokens") > 0, F.col("chars") / F.col("tokens")), F.lit(0.0)).alias("chars_per_token"))
