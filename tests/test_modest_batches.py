from siltstone.operators import bpe, dedupe, tokens


def test_texts_come_in_modest_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, f"a text of some words {i}") for i in range(5)], "ord long, text string")
    for use in (
        lambda: dedupe.dedupe_stream(docs).count(),
        lambda: tokens.pack_windows(docs.select("ord", tokens.byte_stream(docs.text).alias("ids")), 8).count(),
        lambda: bpe.encode(docs, bpe.Model(())),
    ):
        spark.conf.set(key, "10000")
        use()
        assert spark.conf.get(key) == "500"
