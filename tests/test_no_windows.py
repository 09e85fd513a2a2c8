"""The queries of the corpus build seek near-duplicates among all documents, as their SQL does, not in windows of 50,000."""

from pyspark.sql import functions as F

from siltstone.plans.queries import QUERIES


def test_a_copy_beyond_50000_documents_goes(spark, tmp_path):
    word = lambda i: F.md5(F.concat(F.col("of").cast("string"), F.lit(f":{i}")).cast("binary"))
    line = lambda lo: F.concat_ws(" ", *[word(i) for i in range(lo, lo + 5)])
    docs = spark.range(50_003).withColumn("of", F.col("id") % 50_000)
    text = F.concat(line(0), F.lit("\n"), line(5))
    text = F.when(F.col("id") < 50_000, text).otherwise(F.upper(text))  # the same shingles, so any LSH shows them
    docs.select((F.col("id") * 4).alias("doc_id"), text.alias("text"), F.lit("s").alias("source")).write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["corpus_per_source"](spark, str(tmp_path)).collect() == [("s", 50_000)]
    assert QUERIES["corpus_survivors"](spark, str(tmp_path)).agg(F.count("*"), F.max("doc_id")).first() == (50_000, 4 * 49_999)
