"""A linear runner of named stages that reports events and can be stopped between stages, and a command line."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable


def run_stages(stages: list[tuple[str, Callable[[], object]]], on_event: Callable[[dict], None] = lambda e: None, should_stop: Callable[[], bool] = lambda: False) -> dict[str, object]:
    """Results by stage. Events: start and done of each stage, then finished, cancelled or error."""
    results: dict[str, object] = {}
    for name, stage in stages:
        if should_stop():
            on_event({"event": "cancelled", "stage": name})
            return results
        on_event({"event": "start", "stage": name})
        began = time.perf_counter()
        try:
            results[name] = stage()
        except Exception as e:
            on_event({"event": "error", "stage": name, "message": f"{type(e).__name__}: {e}"})
            raise
        on_event({"event": "done", "stage": name, "seconds": round(time.perf_counter() - began, 2)})
    on_event({"event": "finished"})
    return results


def main(argv: list[str] | None = None) -> int:
    """Builds a corpus from JSONL or a folder: shards and a manifest."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("input", nargs="+", help="JSONL files or folders, one after the other; NAME=PATH names a source")
    p.add_argument("out_dir")
    p.add_argument("--kind", choices=("prose", "code"), default="prose", help="of rows that do not say")
    p.add_argument("--limit", type=int, help="only the first documents of each input")
    p.add_argument("--seed", type=int, help="near-duplicates are sought in an order shuffled by it")
    p.add_argument("--folder", action="store_true", help="the input is a folder of documents, not JSONL")
    p.add_argument("--prefix", default="corpus")
    p.add_argument("--window", type=int, default=50_000)
    p.add_argument("--threshold", type=float, default=0.8)
    p.add_argument("--max-docs", type=int, default=100_000)
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from ..operators.dedupe import numbered
    from ..sources import folder, jsonl, sinks
    from .corpus import build, counts_by, manifest, survivors

    spark = SparkSession.builder.getOrCreate()
    if a.folder:
        found = [numbered(folder.documents(spark, path, apply_filters=False).filter("status = 'kept'"), ["ord", "line"]).drop("ord").withColumnRenamed("rn", "ord") for path in a.input]
        docs = jsonl.chain([f if a.limit is None else f.filter(F.col("ord") < a.limit) for f in found])
    else:
        named = [x.split("=", 1) if "=" in x else ("local", x) for x in a.input]
        docs = jsonl.chain([jsonl.stream_local(spark, path, name, a.kind, a.limit) for name, path in named])
    began = time.perf_counter()
    built = build(docs, a.window, a.threshold, a.seed)
    shards = sinks.write_shards(survivors(built), a.out_dir, a.prefix, a.max_docs)
    per_source = {r.source: r["documents"] for r in survivors(built).groupBy("source").agg(F.count("*").alias("documents")).toLocalIterator()}
    dropped = {r.reason: r["documents"] for r in counts_by(built, "reason").toLocalIterator()}  # a row a reason
    sinks.write_manifest(manifest(built, a.max_docs), f"{a.out_dir}/manifest.json", shards=shards, per_source=per_source, dropped_by_filter=dropped, seconds=round(time.perf_counter() - began, 2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
