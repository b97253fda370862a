"""Nearest rows of many queries by products of matrices: the same rows and scores as by the cosine of each pair."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidara.functions.vectors import cosine
from evidara.operators import ranking


def plain(v, q, k):
    d = v.join(F.broadcast(q)).select("qid", "vec_id", F.round(cosine(F.col("vector"), F.col("q")), 9).alias("score"))
    n = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return d.withColumn("rank", n).filter(F.col("rank") <= k)


def test_same_rows_as_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SCORES", 60)
    rng = random.Random(3)
    one = lambda: [rng.gauss(0, 1) for _ in range(8)]
    copied = one()
    rows = [one() for _ in range(60)] + [copied] * 30 + [[0.0] * 8, None, [1.0, 2.0], [None] + [1.0] * 7, [-0.0] * 8, [float("nan")] + [1.0] * 7, []]
    v = spark.createDataFrame([(97 * i % 101, r) for i, r in enumerate(rows)], "vec_id long, vector array<double>").repartition(3)
    asked = [one() for _ in range(5)] + [copied, [0.0] * 8, None, [2.0, 1.0], [None, 1.0], [-x for x in copied]]
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, q array<double>")
    for block in (4, 2048):
        got = ranking.top_vectors_many(v, q, 7, "vec_id", "qid", block)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain(v, q, 7).collect()))


def test_pairs_stay_in_tasks(spark):
    """No row for each pair of a query and a vector leaves the tasks, not even of copies."""
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4000)], "vec_id long, vector array<double>").repartition(2)
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "qid long, q array<double>")
    asked = [list(r.q) for r in q.orderBy("qid").collect()]
    found = v.select(F.col("vec_id").alias("key"), "vector").mapInArrow(ranking._nearest_rows(asked, 5), "i int, key long, score double")
    assert found.count() <= 2 * 5 * 20
    assert {(r.qid, r.vec_id) for r in ranking.top_vectors_many(v, q, 5, "vec_id", "qid").collect()} == {(i, j) for i in range(20) for j in range(5)}
