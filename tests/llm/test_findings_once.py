from siltstone.llm import _shared, secretscan


def test_findings_are_made_once(spark, monkeypatch):
    tags = []
    monkeypatch.setattr(secretscan, "written", lambda df, tag: tags.append(tag) or _shared.written(df, tag))
    rows = spark.createDataFrame([("abc123abc123abc1", "token=", " ", "", 1), ("word", "the ", " ", "", 0)] * 8, "value string, before string, after string, path string, label int")
    assert len(secretscan.train(rows, trees=2)) == 2 and tags == ["findings"]
