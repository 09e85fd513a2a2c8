"""Command line for post-training sets: ``python -m siltstone.plans.post sft --source openhermes=PATH ... --out DIR``."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import post
from ..operators.dedupe import numbered
from ..sources import sinks
from ..sources.jsonl import ordered_lines

NAMES = {"sft": "train", "dpo": "prefs"}


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """(ord, row) of JSONL lines; a line that is no JSON is an error of the whole source."""
    lines = ordered_lines(spark, path).select("file", "line", F.parse_json("value").alias("row"))
    places = numbered(lines.select("file", "line"), ["file", "line"]).withColumnRenamed("rn", "ord")
    return lines.join(places, ["file", "line"]).select("ord", "row")


def build(spark: SparkSession, kind: str, paths: dict[str, str], out_dir: str, target: int | None = None, only: str | None = None, val_fraction: float = 0.02, read_multiplier: float = 2.5, seed: int = 0) -> dict | None:
    """Writes the set's train and validation files and its manifest; the manifest, or null if nothing was collected."""
    began = time.perf_counter()
    missing = [s.name for s in post.chosen_sources(post.MIXES[kind], only) if s.name not in paths]
    if missing:
        raise KeyError(f"no path for {', '.join(missing)}")
    sources = {n: lambda p=p: raw_rows(spark, p) for n, p in paths.items()}
    items, report = post.collect(sources, kind, target or (50_000 if kind == "sft" else 20_000), None, only, read_multiplier, seed)
    if items is None or items.isEmpty():
        return None
    payload = F.struct(F.col("item").alias("messages")) if kind == "sft" else F.col("item")
    rows = items.select("place", "source", "ord", payload.alias("p")).select("place", "source", "ord", "p.*")
    split = sinks.write_split(rows, out_dir, NAMES[kind], val_fraction, ["place", "source", "ord"])
    manifest = {"kind": kind, "total": sum(split.values()), **split, "seconds": round(time.perf_counter() - began, 1), **report}
    sinks.write_meta(f"{out_dir}/manifest.json", **manifest)
    return manifest


def main(argv: list[str] | None = None) -> int:
    """Collects a mix of sources into a post-training set."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("kind", choices=sorted(NAMES))
    p.add_argument("--source", action="append", default=[], metavar="NAME=PATH", help="JSONL of a source of the mix")
    p.add_argument("--out", required=True)
    p.add_argument("--target", type=int)
    p.add_argument("--only", help="a single source, with all of the target")
    p.add_argument("--val-fraction", type=float, default=0.02)
    p.add_argument("--read-multiplier", type=float, default=2.5)
    p.add_argument("--seed", type=int, default=0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    made = build(spark, a.kind, dict(s.split("=", 1) for s in a.source), a.out, a.target, a.only, a.val_fraction, a.read_multiplier, a.seed)
    print(json.dumps(made) if made else "nothing was collected")
    return 0 if made else 1


if __name__ == "__main__":
    raise SystemExit(main())
