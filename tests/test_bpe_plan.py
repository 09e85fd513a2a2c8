from siltstone.functions import session
from siltstone.operators import bpe


def test_words_become_symbols_after_the_count(spark, monkeypatch):
    plans = []

    def seen(df, tag):
        plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString()))
        return session.stored(df, tag)

    monkeypatch.setattr(bpe, "stored", seen)
    docs = spark.createDataFrame([("low lower lowest low",)], "text string")
    bpe.train(bpe.word_counts(docs), 300)
    tag, plan = plans[0]
    assert tag == "words" and plan.index("ArrowEvalPython") < plan.index("Aggregate")
