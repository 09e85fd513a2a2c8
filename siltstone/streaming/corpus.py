"""The corpus build as Structured Streaming: stateless rules, exact duplicates by state, near duplicates by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import near_duplicates
from ..operators.quality import normalise_and_judge


def cleaned_stream(docs: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """A stream of kept documents, exact duplicates dropped.

    The state holds a digest a document. With a watermark (column, delay) it is forgotten after the delay; without, it
    grows with the stream, as exact deduplication of everything must.
    """
    kept = normalise_and_judge(docs, compose=True).filter(F.col("reason").isNull()).drop("reason")
    keyed = kept.withColumn("digest", F.sha2("text", 256))
    if watermark is None:
        return keyed.dropDuplicates(["digest"]).drop("digest")
    return keyed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["digest"]).drop("digest")


def near_dedupe_batches(path: str, threshold: float = 0.8):
    """A foreachBatch function: each micro-batch is a window, its survivors are written under its number.

    Writing a batch again replaces it, so a restart repeats nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        gone = near_duplicates(batch.select("ord", "text", F.lit(0).cast("long").alias("window")), threshold=threshold).select("ord")
        batch.join(gone, "ord", "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return write


def run(docs: DataFrame, out: str, checkpoint: str, threshold: float = 0.8, watermark: tuple[str, str] | None = None):
    """Starts the stream with what is there now (``availableNow``) and returns its query."""
    stream = cleaned_stream(docs, watermark).writeStream.foreachBatch(near_dedupe_batches(out, threshold))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
