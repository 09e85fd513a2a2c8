"""Sinks: compressed JSONL shards, splits, token files, manifests. Parquet is Spark's own and needs none of these."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedupe import numbered
from ..operators.tokens import slices, with_offsets
from .parts import write_parts


def write_shards(docs: DataFrame, out_dir: str, prefix: str = "corpus", max_docs: int = 100_000, order: str = "ord", level: int = 6) -> int:
    """``{prefix}-{n:05d}.jsonl.zst`` with up to ``max_docs`` rows each (text, source, kind), in order; the number of shards.

    They are committed together (see ``parts``); ``out_dir`` must be a folder that all workers share, or in a store.
    """
    line = F.concat(F.to_json(F.struct("text", "source", "kind"), {"ignoreNullFields": "false"}), F.lit("\n"))
    rows = numbered(docs.select(order, "text", "source", "kind"), [order])
    rows = rows.select(F.floor(F.col("rn") / max_docs).alias("part"), F.col("rn").alias("at"), F.encode(line, "UTF-8").alias("data"))
    return len(write_parts(rows, out_dir, prefix, ".jsonl.zst", level))


def write_json_rows(rows: DataFrame, path: str, order: list[str]) -> int:
    """One JSONL file of the columns beside the order's, written by one task: for sets of training examples, which are small."""
    folder, _, name = path.rpartition("/")
    line = F.concat(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in order])), F.lit("\n"))
    made = write_parts(rows.select(F.lit(0).alias("part"), F.struct(*order).alias("at"), F.encode(line, "UTF-8").alias("data")), folder or ".", name.removesuffix(".jsonl"), ".jsonl", single=True)
    return sum(p["rows"] for p in made)


def write_split(items: DataFrame, out_dir: str, name: str, val_fraction: float, order: list[str]) -> dict:
    """``{name}.jsonl`` and ``{name}_val.jsonl``: the head of the order is the validation set, at least one row."""
    from ..operators.chat import train_val_split

    split = train_val_split(items, order, val_fraction)
    out = {}
    for part, keep in (("train", ~F.col("is_val")), ("val", F.col("is_val"))):
        file = f"{name}.jsonl" if part == "train" else f"{name}_val.jsonl"
        out[part] = write_json_rows(split.filter(keep).drop("is_val"), os.path.join(out_dir, file), order)
    return out


@F.arrow_udf(T.BinaryType())
def _sixteen_bits(ids):
    import numpy as np
    import pyarrow as pa

    flat, ends = np.asarray(ids.flatten()), np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
    if len(flat) and (flat.min() < 0 or flat.max() > 65_535):
        raise ValueError("an id does not fit in 16 bits")
    packed = flat.astype("<u2")
    return pa.array([packed[lo:hi].tobytes() for lo, hi in zip([0, *ends], ends, strict=False)], pa.binary())


def write_bin(stream: DataFrame, out_dir: str, prefix: str = "tokens", part_tokens: int = 1 << 28, order: str = "ord") -> int:
    """Token ids as little-endian unsigned 16-bit numbers in files of ``part_tokens`` tokens each; the number of tokens.

    Only the last part may be shorter, so the token at a place of the stream is in part place // part_tokens; the parts one
    after the other are the flat file. They are committed together (see ``parts``).
    """
    rows = slices(with_offsets(stream, order), part_tokens, 0)
    made = write_parts(rows.select(F.col("win").alias("part"), "at", _sixteen_bits("ids").alias("data")), out_dir, prefix, ".bin")
    return sum(p["bytes"] for p in made) // 2


def write_meta(path: str, **values) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, indent=2)


def load_meta(folder: str) -> dict:
    path = os.path.join(folder, "meta.json")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_manifest(manifest: DataFrame, path: str, **more) -> dict:
    """A one-row frame of counts as a JSON file."""
    values = manifest.first().asDict() | more
    write_meta(path, **values)
    return values


def save_tokenizer(tokenizer, path: str, chars_per_token: float | None = None) -> None:
    tokenizer.save(path)
    write_meta(path.removesuffix(".json") + ".info.json", vocab_size=tokenizer.get_vocab_size(), chars_per_token=chars_per_token)
