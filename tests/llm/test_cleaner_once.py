from siltstone.llm import decontam


def test_texts_are_cleaned_once(spark):
    """The filter had a call of its own: each text was walked twice, and each task held two Python workers."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (2, "x y"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "c d e f g h i j k l")], "item_id string, text string")
    out = decontam.decontaminate(docs, items)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["a b   m n o p q r s t u v w x y z".replace("   ", "  "), "x y", None]
