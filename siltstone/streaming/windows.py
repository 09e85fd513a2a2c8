"""Near-duplicates of a stream in windows of exactly so many documents, however its micro-batches are cut.

Each micro-batch is numbered in its order, from where the one before it ended. Windows that are full are searched and
their survivors written under the batch's number; the documents of the last, unfinished one wait in a stored table. What
a batch leaves behind is written under its own number and read by the next one only, so a batch that is repeated after
a failure starts from the same state and replaces its own results. Numbering, searching and waiting are Spark jobs over
whole tables: no state has a single key, and no task holds a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import forgotten, stored
from ..operators.dedupe import near_duplicates, numbered


class CountWindows:
    """A ``foreachBatch`` function over rows with ord and text; ``finish`` flushes the last window when the stream has ended.

    Results are ``out``/batch=N, state is ``state``/batch=N; both folders must be shared. Rows are ordered by ``ord`` within
    a micro-batch and by micro-batch.
    """

    def __init__(self, out: str, state: str, window: int = 50_000, threshold: float = 0.8):
        self.out, self.state, self.window, self.threshold = out, state, window, threshold

    def _files(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _waiting(self, spark: SparkSession, number: int) -> tuple[DataFrame, int]:
        """The rows that batch ``number`` left waiting, and how many rows there were before and in it."""
        rows = spark.read.parquet(f"{self.state}/batch={number}/rows")
        return rows, spark.read.parquet(f"{self.state}/batch={number}/count").first()["rows"]

    def _survivors(self, rows: DataFrame, number: int) -> None:
        gone = near_duplicates(rows.select("ord", "text", F.col("_window").alias("window")), threshold=self.threshold).select("ord")
        rows.join(gone, "ord", "left_anti").drop("_window").write.mode("overwrite").parquet(f"{self.out}/batch={number}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting, before = self._waiting(spark, number - 1) if number else (None, 0)
        fresh = stored(numbered(batch, ["ord"]).withColumn("_window", F.floor((F.col("rn") + before) / self.window).cast("long")).drop("rn"), "batch")
        rows, total = (fresh if waiting is None else waiting.unionByName(fresh)), before + fresh.count()
        full = total // self.window
        self._survivors(rows.filter(F.col("_window") < full), number)
        rows.filter(F.col("_window") >= full).write.mode("overwrite").parquet(f"{self.state}/batch={number}/rows")
        spark.createDataFrame([(total,)], "rows long").write.mode("overwrite").parquet(f"{self.state}/batch={number}/count")
        forgotten(fresh)
        files, old = self._files(spark, f"{self.state}/batch={number - 2}")
        files.delete(old, True)  # this batch, if repeated, reads the one before it

    def finish(self, spark: SparkSession) -> None:
        """The survivors of the last window, which may be short; repeating it replaces them."""
        files, at = self._files(spark, self.state)
        if not files.exists(at):
            return
        last = max(int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(at))
        rows, _ = self._waiting(spark, last)
        self._survivors(rows, last + 1)
