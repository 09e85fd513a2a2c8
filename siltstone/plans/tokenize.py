"""Command line: ``python -m siltstone.plans.tokenize train SHARDS tokenizer.json`` and ``... encode SHARDS tokenizer.json OUT``."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import stored
from ..operators import bpe, tokens
from ..operators.dedupe import numbered
from ..sources import sinks
from ..sources.jsonl import read_shards


def documents(spark: SparkSession, shards: str, limit: int | None = None) -> DataFrame:
    """(ord, text) of a folder's shards, in order."""
    rows = numbered(read_shards(spark, shards), ["file", "line"])
    return (rows if limit is None else rows.filter(F.col("rn") < limit)).select(F.col("rn").alias("ord"), "text")


def train(spark: SparkSession, shards: str, out: str, vocab_size: int = 32_768, min_frequency: int = 2, limit: int | None = None, sample: int = 500) -> dict:
    """Learns a tokenizer from shards and writes it with its info; characters a token are those of the first documents."""
    docs = stored(documents(spark, shards, limit), "documents")
    many = docs.count()
    if not many:
        raise ValueError(f"no documents in {shards}")
    model = tokens.train_bpe(docs, vocab_size, min_frequency)
    first = tokens.encode(docs.filter(F.col("ord") < sample), model, eos=False)
    ratio = tokens.compression_ratio(first).first()["chars_per_token"]
    model.save(out)
    info = {"vocab_size": model.get_vocab_size(), "special_tokens": list(bpe.SPECIAL_TOKENS), "documents_trained_on": many, "chars_per_token": round(ratio, 3)}
    sinks.write_meta(f"{out}.info.json", **info)
    return info


def encode(spark: SparkSession, shards: str, tokenizer: str, out: str, val_tokens: int = 10_000_000, limit: int | None = None, part_tokens: int = 1 << 28) -> dict:
    """Writes train and val parts of 16-bit ids and ``meta.json``; the head of the documents is the validation set."""
    began = time.perf_counter()
    model = bpe.Model.load(tokenizer)
    split = stored(tokens.val_budget_split(tokens.encode(documents(spark, shards, limit), model), val_tokens).select("ord", "ids", "is_val"), "split")
    if split.filter(~F.col("is_val")).isEmpty():
        raise ValueError("no training tokens are left: the validation set takes all documents")
    counts = {name: sinks.write_bin(split.filter(F.col("is_val") == (name == "val")), out, name, part_tokens) for name in ("val", "train")}
    meta = {"vocab_size": model.get_vocab_size(), "train_tokens": counts["train"], "val_tokens": counts["val"], "dtype": "uint16", "eos_id": tokens.EOS, "part_tokens": part_tokens, "seconds": round(time.perf_counter() - began, 2)}
    sinks.write_meta(f"{out}/meta.json", **meta)
    return meta


def main(argv: list[str] | None = None) -> int:
    """Learns a tokenizer from shards, or encodes shards with one."""
    p = argparse.ArgumentParser(description=main.__doc__)
    of = p.add_subparsers(dest="command", required=True)
    one = of.add_parser("train")
    one.add_argument("shards")
    one.add_argument("out")
    one.add_argument("--vocab", type=int, default=32_768)
    one.add_argument("--min-frequency", type=int, default=2)
    two = of.add_parser("encode")
    two.add_argument("shards")
    two.add_argument("tokenizer")
    two.add_argument("out")
    two.add_argument("--val-tokens", type=int, default=10_000_000)
    two.add_argument("--part-tokens", type=int, default=1 << 28)
    for each in (one, two):
        each.add_argument("--limit", type=int, help="only the first documents")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    made = train(spark, a.shards, a.out, a.vocab, a.min_frequency, a.limit) if a.command == "train" else encode(spark, a.shards, a.tokenizer, a.out, a.val_tokens, a.limit, a.part_tokens)
    print(json.dumps(made))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
