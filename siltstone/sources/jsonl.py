"""JSONL and Parquet sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators.chat import truthy
from ..operators.dedupe import numbered

MESSAGES = T.StructType([T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))])
PREFERENCES = T.StructType([T.StructField(n, T.StringType()) for n in ("prompt", "chosen", "rejected")])


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of a file, a folder's ``*.jsonl`` or a glob, lines ended by LF only and numbered from 0; blank ones are left out.

    Files are read in byte ranges, so one of any size takes many tasks. A first pass counts the lines of each range; their
    sums within the file number the second pass's lines, which come in the order of the range. Files go by name.
    """
    read = spark.read.option("pathGlobFilter", "*") if path.endswith((".jsonl", ".txt", ".ndjson")) or "*" in path else spark.read.option("pathGlobFilter", "*.jsonl")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("id")]
    ranges = read.text(path, lineSep="\n").select(*place).groupBy("file", "range").agg(F.count("*").alias("lines"), F.min("id").alias("first"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("range")) - F.col("lines")  # a row a range
    lines = read.text(path, lineSep="\n").select(*place, "value").filter(t.strip(F.col("value")) != "")
    placed = lines.join(ranges.withColumn("before", before), ["file", "range"])
    return placed.select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def stream_local(spark: SparkSession, path: str, name: str = "local", kind: str = "prose", limit: int | None = None) -> DataFrame:
    """ord, text, source, kind of JSONL rows: ``text`` or else ``content``; a row's own source and kind win.

    The limit counts kept rows. A line that is not a JSON object is an error.
    """
    schema = "text string, content string, source string, kind string"
    rows = ordered_lines(spark, path).withColumn("r", F.from_json("value", schema, {"mode": "FAILFAST"}))
    text = truthy(F.col("r.text"), F.col("r.content"))
    kept = rows.select("file", "line", text.alias("text"), F.coalesce("r.source", F.lit(name)).alias("source"), F.coalesce("r.kind", F.lit(kind)).alias("kind")).filter("text is not null")
    if limit is not None:
        kept = numbered(kept, ["file", "line"]).filter(F.col("rn") < limit).drop("rn")
    order = F.struct("file", "line")
    return kept.withColumn("at", order).select("at", "text", "source", "kind")


def stream_table(rows: DataFrame, source: str, kind: str, text_key: str = "text", order: str = "ord", limit: int | None = None) -> DataFrame:
    """ord, text, source, kind of a table; the limit counts rows before empty texts are dropped."""
    if limit is not None:
        rows = numbered(rows, [order]).filter(F.col("rn") < limit).drop("rn")
    out = rows.select(F.col(order).alias("ord"), F.col(text_key).alias("text"), F.lit(source).alias("source"), F.lit(kind).alias("kind"))
    return out.filter((F.col("text") != "") & F.col("text").isNotNull())


def chain(frames: list[DataFrame]) -> DataFrame:
    """Sources (text, source, kind and ``at`` or ``ord``) one after the other; ``ord`` numbers all rows from 0, so they can be built from."""
    out = None
    for place, frame in enumerate(frames):
        own = frame if "ord" in frame.columns else numbered(frame, ["at"]).withColumnRenamed("rn", "ord")
        own = own.select(F.lit(place).alias("place"), F.col("ord").cast("long").alias("own"), "text", "source", "kind")
        out = own if out is None else out.unionByName(own)
    return numbered(out, ["place", "own"]).select(F.col("rn").alias("ord"), "text", "source", "kind")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of messages; a row without them is an error that names its file and line."""
    rows = ordered_lines(spark, path).withColumn("m", F.from_json("value", MESSAGES, {"mode": "FAILFAST"})["messages"])
    where = F.concat_ws(":", "file", (F.col("line") + 1).cast("string"))
    missing = F.raise_error(F.concat(F.lit("no messages at "), where)).cast(MESSAGES["messages"].dataType)
    return rows.select("file", "line", F.coalesce("m", missing).alias("messages"))


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    rows = ordered_lines(spark, path).withColumn("p", F.from_json("value", PREFERENCES, {"mode": "FAILFAST"}))
    return rows.select("file", "line", "p.*")


DEFAULT_PROMPTS = ("The history of the compass begins", "def fibonacci(n):", "Water boils at", "Once upon a time", "The main difference between a list and a tuple is")


def load_prompts(spark: SparkSession, path: str | None) -> DataFrame:
    """Prompts of a JSONL file, from objects' ``prompt`` or from plain values; a default list without a file."""
    if path is None:
        return spark.createDataFrame([(i, p) for i, p in enumerate(DEFAULT_PROMPTS)], "line int, prompt string")
    v = F.parse_json("value")
    own = F.try_variant_get(v, "$.prompt", "string")
    return ordered_lines(spark, path).select("line", F.coalesce(own, F.try_variant_get(v, "$", "string")).alias("prompt"))


def ranked_limit(rows: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """The first rows of each group; Spark prunes each task's rows before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def read_shards(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(file, line, text, source, kind) of ``*.jsonl.zst`` shards, decompressed on the workers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl.zst").load(folder).select("path", "content")
    schema = "file string, line long, text string, source string, kind string"

    def opened(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = zstandard.ZstdDecompressor().stream_reader(content.as_py()).read().decode()
                rows = [json.loads(x) for x in data.split("\n") if x.strip()]
                yield pa.record_batch(
                    [pa.array([path.as_py()] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *[pa.array([r.get(k) for r in rows], pa.string()) for k in ("text", "source", "kind")]],
                    names=["file", "line", "text", "source", "kind"],
                )

    out = files.mapInArrow(opened, schema)
    return out if limit is None else numbered(out, ["file", "line"]).filter(F.col("rn") < limit).drop("rn")
