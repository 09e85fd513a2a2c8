import random

import pytest

from siltstone.operators.dedupe import near_duplicates, numbered
from siltstone.streaming.windows import CountWindows


def documents(n=70, seed=4):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if i % 5 == 4 and i > 8:
            words = texts[rng.randrange(max(0, i - 25), i)].split()
            words[rng.randrange(len(words))] = "changed"
        else:
            words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts.append(" ".join(words))
    return [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def want(spark):
    docs = spark.createDataFrame(documents(), "ord long, text string, source string")
    cut = numbered(docs, ["ord"]).selectExpr("ord", "text", "CAST(floor(rn / 16) AS BIGINT) AS window")
    gone = {r.ord for r in near_duplicates(cut).collect()}
    everywhere = {r.ord for r in near_duplicates(cut.selectExpr("ord", "text", "0L AS window")).collect()}
    assert 3 < len(gone) < len(everywhere)
    return sorted(set(range(70)) - gone)


@pytest.mark.parametrize("cuts", [[70], [5, 40, 41, 48, 70], [16, 32, 33, 70]])
def test_same_survivors_for_any_cut(spark, tmp_path, want, cuts):
    rows = documents()
    windows = CountWindows(str(tmp_path / "out"), str(tmp_path / "state"), 16)
    for number, (lo, hi) in enumerate(zip([0, *cuts], cuts, strict=False)):
        windows(spark.createDataFrame(rows[lo:hi], "ord long, text string, source string").repartition(3), number)
    windows.finish(spark)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.ord for r in found.collect()) == want and set(found.columns) == {"ord", "text", "source", "batch"}
    CountWindows(str(tmp_path / "none"), str(tmp_path / "no_state"), 16).finish(spark)


def test_stream_that_fails_and_starts_again(spark, tmp_path, want):
    rows = documents()
    for k, lo in enumerate(range(0, 70, 23)):
        spark.createDataFrame(rows[lo : lo + 23], "ord long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        (part,) = (tmp_path / "in" / f"{k}").glob("part-*.parquet")
        part.rename(tmp_path / f"{k}.parquet")
    windows, failed = CountWindows(str(tmp_path / "out"), str(tmp_path / "state"), 16), []

    def write(batch, number):
        windows(batch, number)
        if number == 1 and not failed:
            failed.append(number)  # after its results and state are there, before Spark knows
            raise RuntimeError("lost")

    def run():
        stream = spark.readStream.schema("ord long, text string, source string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*.parquet"))
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    windows.finish(spark)
    windows.finish(spark)
    assert failed and sorted(r.ord for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
