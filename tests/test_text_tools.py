"""Queries of text tools: what is costly is worked out once for each text."""

from evidara.queries import QUERIES


def test_tokens_of_a_text_are_made_once(spark):
    df = QUERIES["shingle_tokens"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1
    rows = df.collect()
    assert rows and all(r.n == len(r.tokens.split(" ")) > 0 for r in rows)
