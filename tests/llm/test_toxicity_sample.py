from __future__ import annotations

from korridor.llm import toxicity


def test_toxicity_learns_from_the_stated_sample(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(6000).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS INT) AS toxic")
    got = [y for _, y in toxicity.labelled_sample(docs, labels)]
    assert (got.count(1), got.count(0)) == (1000, 2000)
