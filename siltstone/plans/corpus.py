"""The corpus build: one wide frame of stages, from which survivors and manifest both derive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import stored
from ..operators.dedupe import all_near_duplicates, near_duplicates, numbered
from ..operators.quality import normalise_and_judge


def build(docs: DataFrame, window: int | None = 50_000, threshold: float = 0.8, shuffle_seed: int | None = None, compose: bool = True, complete: bool = False) -> DataFrame:
    """``docs`` (ord, text, source, kind) with reason, is_exact_dup and is_near_dup.

    Near-duplicates are sought among filtered, exactly distinct documents, in windows of their order (or of a hashed
    order, if a shuffle seed is given). The judged frame is stored once; every later step reads its narrow columns.
    ``complete`` takes every link of all documents instead of those that LSH buckets show; it knows no windows.
    """
    if complete and (window is not None or threshold != 0.8):
        raise ValueError("the complete search has no windows, and its threshold is 0.8")
    judged = stored(normalise_and_judge(docs, compose=compose).withColumns({"chars": F.length("text"), "digest": F.sha2("text", 256)}), "judged")
    kept = judged.filter(F.col("reason").isNull())
    first = kept.groupBy("digest").agg(F.min("ord").alias("ord"))
    if complete:  # copies are in their first one's component, so all that is kept may take part and no text needs a join
        near = all_near_duplicates(kept.select("ord", "text", "digest"), digest="digest")
    else:
        near = _near_in_windows(kept, first, window, threshold, shuffle_seed)
    near = near.select("ord", F.lit(True).alias("is_near_dup"))
    flags = first.select("ord", F.lit(True).alias("_first")).join(near, "ord", "left")
    out = judged.join(flags, "ord", "left")
    exact = F.col("reason").isNull() & F.col("_first").isNull()
    return out.withColumns({"is_exact_dup": exact, "is_near_dup": F.coalesce("is_near_dup", F.lit(False))}).drop("_first")


def _near_in_windows(kept: DataFrame, first: DataFrame, window: int | None, threshold: float, shuffle_seed: int | None) -> DataFrame:
    distinct = kept.select("ord", "text").join(first.select("ord"), "ord", "left_semi")
    if window is None:
        cut = distinct.withColumn("window", F.lit(0).cast("long"))
    else:
        place = ["ord"] if shuffle_seed is None else ["_key", "ord"]
        keys = distinct.select("ord") if shuffle_seed is None else distinct.select("ord", shuffle_key(F.col("ord"), shuffle_seed).alias("_key"))
        cut = distinct.join(numbered(keys, place).select("ord", F.floor(F.col("rn") / window).alias("window")), "ord")
    return near_duplicates(cut, threshold=threshold)


def survivors(built: DataFrame) -> DataFrame:
    return built.filter(F.col("reason").isNull() & ~F.col("is_exact_dup") & ~F.col("is_near_dup"))


def shuffle_key(order, seed: int = 0):
    """Sorting by it shuffles: a digest of the document's place and the seed."""
    return F.md5(F.concat(order.cast("string"), F.lit(f":{seed}")).cast("binary"))


def manifest(built: DataFrame, docs_per_shard: int = 100_000) -> DataFrame:
    """One row of counts of a built frame."""
    kept = F.col("reason").isNull()
    out = kept & ~F.col("is_exact_dup") & ~F.col("is_near_dup")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    chars = F.coalesce(F.sum(F.when(out, F.col("chars")).otherwise(0)), F.lit(0))
    return built.agg(
        F.count("*").alias("documents_in"),
        n(kept).alias("passed_filters"),
        n(~kept).alias("dropped"),
        n(F.col("is_exact_dup")).alias("removed_exact_duplicates"),
        n(F.col("is_near_dup")).alias("removed_near_duplicates"),
        n(out).alias("documents_out"),
        chars.alias("characters_out"),
        F.floor(chars / 4).alias("estimated_tokens"),
        F.ceil(n(out) / docs_per_shard).alias("shards"),
    )


def counts_by(built: DataFrame, column: str) -> DataFrame:
    """Survivors (by source) or drops (by reason)."""
    rows = survivors(built) if column == "source" else built.filter(F.col("reason").isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("documents"))
