"""Candidates of many needles: work that grows with the needles, not with needles times identifiers."""

from evidara.operators import entities as N


def records_shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_frequent_word_is_not_met_once_for_each_needle(spark):
    n = 300
    people = spark.createDataFrame([(f"e{i:04d}", f"Person {i:04d}", 1.0) for i in range(n)], "entity_id string, display_name string, confidence double")
    rows = [row for i in range(n) for row in ((f"e{i:04d}", "display_name", f"Person {i:04d}", 0.7), (f"e{i:04d}", "remark", "Builders", 0.6))]
    identifiers = spark.createDataFrame(rows, "entity_id string, kind string, value string, confidence double")
    asked = [f"builders {i:04d}" for i in range(n)] + ["builders nobody", "Person builders zz"]
    before = records_shuffled(spark)
    got = N.candidates_of_many(people, identifiers, spark.createDataFrame([(a,) for a in asked], "needle string")).collect()
    assert sorted((r.needle, r.entity_id, r.stage, r.confidence) for r in got) == [(f"builders {i:04d}", f"e{i:04d}", "words", 0.74) for i in range(n)]
    assert {tuple(r.reasons) for r in got} == {("contact_remark_exact", "identifier_exact", "identifier_partial")}
    assert records_shuffled(spark) - before < n * n / 2


def test_long_parts_are_looked_up_by_long_runs(spark):
    values = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz",), ("abcdef",), ("ab",), ("",)], "v string")
    asked = ["a", "ab", "abc", "cdefg", "abcdef", "fghijklmnopqr", "bcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz!", "aab", ""]
    found = {(r.part, r.v) for r in N._containing(values, spark.createDataFrame([(a,) for a in asked], "part string"), []).collect()}
    assert found == {(a, r.v) for a in asked if a for r in values.collect() if a in r.v}
