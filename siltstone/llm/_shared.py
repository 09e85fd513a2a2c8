"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors see.

    Only where the setting is absent (local tests) a folder of this machine is set instead.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltstone-"))
    return jsc.getCheckpointDir().get()


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives a lost executor, is computed once.

    At most ``files`` tasks write it, a file each, if given. Its shuffle files go when it is written.
    """
    df = df.coalesce(files) if files else df
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def narrow(rows: int) -> int:
    """Files for a table of a few numbers a row, of about so many rows."""
    return max(2, rows // 200_000)


def wide(spark: SparkSession, rows: int) -> int:
    """Files for a table of about so many rows that takes work to make."""
    return max(2 * spark.sparkContext.defaultParallelism, rows // 25_000)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by ``written``; only for those that nothing will read again, not even a lost task."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def private(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns of passing use, none of which ``df`` has, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_results(df: DataFrame, names: list[str], results: dict) -> list:
    """Columns ``names`` of ``df`` and then ``results`` by name; a result takes the place of a column of its name."""
    own = {r.lower() for r in results}
    return [df[f"`{n}`"] for n in names if n.lower() not in own] + [c.alias(n) for n, c in results.items()]


#: Most rows of a broadcast set of buckets: a long and a flag each.
BUCKETS = 1 << 21


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def met(df: DataFrame, key: Column, small: DataFrame, small_key: str) -> DataFrame:
    """``df`` left-joined to ``small`` (one row a ``small_key``), shuffling only rows that may have a partner.

    A broadcast set of hash buckets, of bounded size, tells those rows; the join itself decides. ``small`` must be a
    stored table: it is read twice. Its columns must not be in ``df``.
    """
    (bucket,) = private(df, "bucket")
    wanted = small.select(bucket_of(F.col(small_key)).alias(bucket)).distinct()
    named = df.withColumn(bucket, bucket_of(key))
    some = named.join(F.broadcast(wanted), bucket, "left_semi").drop(bucket)
    rest = named.join(F.broadcast(wanted), bucket, "left_anti").drop(bucket)
    some = some.join(small, key == small[small_key], "left")
    kinds = {f.name: f.dataType for f in small.schema}
    own = [F.col(f"`{c}`") for c in df.columns]
    return some.select(*own, *small.columns).unionByName(rest.select(*own, *[F.lit(None).cast(kinds[c]).alias(c) for c in small.columns]))


def modest_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most ``rows`` rows, where the session has Spark's default of 10,000: rows here are whole texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc_fold(id_col: str, folds: int):
    """crc32 of an id's decimal text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def bounded_threshold(counts: DataFrame, limit: int, count_col: str = "n") -> int:
    """A count that at most ``limit`` rows have or exceed; the smallest one on a scale of a sixteenth of a doubling.

    Works on a histogram of at most 16 x 63 bins; where the highest bin alone is too large, it is counted by value.
    """
    from pyspark.sql import Window

    def least(rows: DataFrame, bin_: Column) -> int | None:
        bins = rows.groupBy(bin_.alias("b")).agg(F.count("*").alias("rows"), F.min(count_col).alias("least"))
        running = F.sum("rows").over(Window.orderBy(F.desc("b")))
        return bins.withColumn("running", running).filter(F.col("running") <= limit).agg(F.min("least").alias("t")).first()["t"]

    log_bin = F.floor(F.log2(F.col(count_col).cast("double")) * 16).cast("int")
    found = least(counts, log_bin)
    if found is not None:
        return int(found)
    top = counts.agg(F.max(count_col).alias("m")).first()["m"]
    if top is None:
        return 1
    found = least(counts.filter(F.col(count_col) > top * 0.95), F.col(count_col))  # at most ``limit`` values fit
    return int(top) + 1 if found is None else int(found)


def word_blocks(data: bytes, size: int = 1 << 20):
    """Cuts bytes at ASCII white space into blocks of about ``size``, so that very long texts need little memory."""
    if len(data) <= size:
        yield data
        return
    at, n = 0, len(data)
    while at < n:
        to = min(at + size, n)
        while to < n and data[to] not in b" \t\n\r\x0b\x0c":
            to += 1
        yield data[at:to]
        at = to
