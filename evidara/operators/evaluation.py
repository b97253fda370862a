"""Measures of retrieval quality over ranked results (case, rank, key) and expectations (case, key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results with relevant: 1 where the key, or one of `also` (anchor, parent, supporting keys) where there is such a column, is expected."""
    e = expected.select("case_id", "key").distinct()
    if "also" not in results.columns:
        return results.join(e.withColumn("__e", F.lit(1)), ["case_id", "key"], "left").withColumn("relevant", F.coalesce("__e", F.lit(0))).drop("__e")
    names = results.select("case_id", "rank", F.explode(F.array_distinct(F.array_append("also", F.col("key")))).alias("key"))
    good = names.join(e, ["case_id", "key"], "left_semi").select("case_id", "rank").distinct().withColumn("__e", F.lit(1))
    return results.join(good, ["case_id", "rank"], "left").withColumn("relevant", F.coalesce("__e", F.lit(0))).drop("__e")


def per_case(cases: DataFrame, results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """For each case: expected, found and hits at k, recall hit, precision, reciprocal rank,
    average precision and NDCG at 3 and k. Cases without results have zeros."""
    from pyspark.sql import Window

    r = judged(results.filter(F.col("rank") <= k), expected)
    w = Window.partitionBy("case_id").orderBy("rank")
    r = r.withColumn("so_far", F.sum("relevant").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gain = F.col("relevant") / F.log2(F.col("rank") + 1)
    m = r.groupBy("case_id").agg(
        F.count("*").alias("returned"),
        F.sum("relevant").alias("hits"),
        F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("relevant") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(gain).alias("dcg"),
        F.sum(F.when(F.col("rank") <= 3, gain).otherwise(0.0)).alias("dcg3"),
    )
    n = expected.select("case_id", "key").distinct().groupBy("case_id").agg(F.count("*").alias("expected"))
    d = cases.join(n, "case_id", "left").join(m, "case_id", "left").fillna(0, ["expected", "returned", "hits", "precisions", "dcg", "dcg3"])
    total = F.greatest(F.col("expected"), F.col("hits"), F.lit(1))
    ideal = lambda at: F.aggregate(F.sequence(F.lit(1), F.least(total, F.lit(at)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return d.select(
        *cases.columns,
        "expected",
        "returned",
        "hits",
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("recall"),
        (F.col("hits") / k).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.col("precisions") / total).alias("ap"),
        (F.col("dcg3") / ideal(3)).alias("ndcg3"),
        (F.col("dcg") / ideal(k)).alias("ndcg"),
    )


def summary(cases: DataFrame, by: list[str]) -> DataFrame:
    """Means of per_case: recall, precision, MRR and MAP over cases that expect something, NDCG over all."""
    positive = F.col("expected") > 0
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(positive, F.col(c))), F.lit(0.0)), 6)
    return cases.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if(positive).alias("positive"), mean("recall").alias("recall"), mean("precision").alias("precision"), mean("mrr").alias("mrr"), mean("ap").alias("map"), F.round(F.avg("ndcg3"), 6).alias("ndcg3"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


FAILURES = ("negative_false_positive", "negative_excluded_citation_in_topk", "no_results", "expected_all_missing", "expected_missing", "expected_retrieval_path_missing", "source_family_missing", "context_failed")


def failure_class(cases: DataFrame, results: DataFrame, expected: DataFrame, excluded: DataFrame, k: int = 10) -> DataFrame:
    """cases with failure: the first of FAILURES that holds, or `ok`.

    cases (case_id, none_expected, all_expected, path, family, context): whether nothing may be
    found, whether all that is expected must be; the path, family and conversation that one
    result must have, null where any may. results (case_id, rank, key, paths, family, context).
    """
    top = results.filter(F.col("rank") <= k)
    has = lambda column, value: F.max(F.coalesce(F.col(column) == F.col(value), F.lit(False)))
    wanted = cases.select("case_id", *(F.col(c).alias(f"__{c}") for c in ("path", "family", "context")))
    seen = top.join(wanted, "case_id").groupBy("case_id").agg(
        F.count("*").alias("returned"),
        F.max(F.coalesce(F.array_contains("paths", F.col("__path")), F.lit(False))).alias("path_ok"),
        has("family", "__family").alias("family_ok"),
        has("context", "__context").alias("context_ok"),
    )
    e, x = (d.select("case_id", "key").distinct() for d in (expected, excluded))
    wanted_n, forbidden_n = e.groupBy("case_id").agg(F.count("*").alias("expected")), x.groupBy("case_id").agg(F.count("*").alias("excluded"))
    found = top.select("case_id", "key").distinct().join(e, ["case_id", "key"], "left_semi").groupBy("case_id").agg(F.count("*").alias("matched"))
    bad = top.select("case_id", "key").distinct().join(x, ["case_id", "key"], "left_semi").groupBy("case_id").agg(F.count("*").alias("bad"))
    j = cases
    for d in (seen, wanted_n, forbidden_n, found, bad):
        j = j.join(d, "case_id", "left")
    j = j.fillna(0, ["returned", "expected", "excluded", "matched", "bad"]).fillna(False, ["path_ok", "family_ok", "context_ok"])
    n = F.col
    rules = [
        (n("none_expected") & (n("returned") > 0), FAILURES[0]), (n("none_expected"), "ok"), (n("bad") > 0, FAILURES[1]), ((n("excluded") > 0) & (n("expected") == 0), "ok"), (n("returned") == 0, FAILURES[2]),
        (n("all_expected") & (n("matched") < n("expected")), FAILURES[3]), ((n("expected") > 0) & (n("matched") == 0), FAILURES[4]),
        (n("path").isNotNull() & ~n("path_ok"), FAILURES[5]), (n("family").isNotNull() & ~n("family_ok"), FAILURES[6]), (n("context").isNotNull() & ~n("context_ok"), FAILURES[7]),
    ]
    c = F.lit("ok")
    for condition, name in reversed(rules):
        c = F.when(condition, name).otherwise(c)
    return j.select(*cases.columns, c.alias("failure"))


def gate(baseline: DataFrame, candidate: DataFrame, keys: list[str], measures: dict[str, tuple[float, float]]) -> DataFrame:
    """Whether each measure of a candidate is at least its floor and at most its allowed loss below the baseline."""
    b = baseline.select(*keys, *(F.col(m).alias(f"__b_{m}") for m in measures))
    j = candidate.join(b, keys, "left")
    ok = F.lit(True)
    for m, (floor, loss) in measures.items():
        ok = ok & (F.col(m) >= floor) & (F.col(m) >= F.coalesce(F.col(f"__b_{m}"), F.lit(0.0)) - loss)
    return j.withColumn("passed", ok).drop(*(f"__b_{m}" for m in measures))
