"""Contracts that a comparison with SQL does not show."""

import pytest
from pyspark.sql import functions as F

from evidara.functions import parsing
from evidara.operators import evaluation, filters, incremental, ranking, windows
from evidara.queries import QUERIES


def test_limits_are_validated():
    assert filters.bounded_limit("search", 50) == 50
    for bad in (0, 51, True, "3"):
        with pytest.raises(ValueError):
            filters.bounded_limit("search", bad)


def test_fusion_sums_over_routes(spark):
    r = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "y")], "key string, rank long, route string")
    got = {x.key: (round(x.score, 9), x.paths) for x in ranking.fuse_rrf(r, {"x": 2.0, "y": 0.0}).collect()}
    assert got == {"a": (round(2 / 61 + 0.01 / 62, 9), ["x", "y"]), "b": (round(0.01 / 61, 9), ["y"])}


def test_top_vectors_of_many_queries(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "vec_id long, vector array<double>")
    q = spark.createDataFrame([(0, [0.0, 1.0]), (1, [2.0, 1.0])], "qid long, q array<double>")
    got = ranking.top_vectors_many(v, q, 3, "vec_id", "qid", block=1).collect()
    assert {(r.qid, r.vec_id) for r in got} == {(0, 0), (0, 3), (0, 6), (1, 2), (1, 5), (1, 8)}


def test_upsert_is_idempotent_and_versions_are_whole(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    b = spark.createDataFrame([(2, None), (3, "c")], "id long, v string")
    assert [r.change for r in incremental.delta(t, b, ["id"]).collect()] == ["new"]
    u = incremental.upsert(t, b, ["id"])
    assert incremental.delta(u, b, ["id"]).count() == 0
    root = str(tmp_path / "table")
    assert incremental.current_version(spark, root) == 0
    assert incremental.write_version(t, root) == 1 and incremental.write_version(u, root) == 2
    assert incremental.read_version(spark, root).count() == 3


def test_unknown_direction_breaks_a_chain(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", "peer"), (2, 1, "2024-01-01 00:01:00", "unknown"), (3, 1, "2024-01-01 00:02:00", "self"), (4, 1, "2024-01-01 00:05:00", "peer")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, direction string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    s = windows.with_sessions(df, ["user_id"], "ts", "event_id", 28_800)
    got = windows.response_minutes(s, ["user_id"], "ts", "event_id", "direction").collect()
    assert [(r.event_id, r.minutes) for r in got] == [(4, 3.0)]


@pytest.mark.parametrize("k, want", [(1, [9]), (4, [0, 3, 6, 9]), (20, list(range(10)))])
def test_spread_sample_keeps_ends(spark, k, want):
    df = spark.createDataFrame([(0, i) for i in range(10)], "g int, i int")
    assert sorted(r.i for r in windows.spread_sample(df, ["g"], ["i"], k).collect()) == want


def test_measures_are_bounded(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1)], "case_id long, key string, rank long")
    expected = spark.createDataFrame([(1, "b"), (2, "q"), (1, "b")], "case_id long, key string")
    got = {r.case_id: r for r in evaluation.per_case(cases, results, expected).collect()}
    assert (got[1].recall, got[1].mrr, got[1].ap) == (1.0, 0.5, 0.5)
    assert got[2].ndcg == 0 and got[3].expected == 0
    assert all(0 <= getattr(r, m) <= 1 for r in got.values() for m in ("recall", "precision", "mrr", "ap", "ndcg3", "ndcg"))


def test_chunks_cover_the_text():
    text = ("A sentence of some words here. " * 120).strip()
    parts = parsing.chunk(text)
    assert all(len(p) <= 900 for p in parts) and parts[0].startswith("A sentence") and text.endswith(parts[-1][-20:])
    assert all(p.endswith(".") for p in parts)
    assert parsing.chunk(None) == [] and parsing.chunk(" ") == [] and parsing.chunk("x" * 2000)[0] == "x" * 900


def test_pages():
    assert parsing.parse_page("<html lang='en'><title>T</title><a href='x'>l</a><script>no</script> b</html>") == ("parsed", "T", "en", 1, "l b")
    assert parsing.parse_page("<title>a&amp;b&amp</title>&lt;&ampx; &#65;&#x42;&copy &middot;<br>&notit;&amp")[1::3] == ("a&b&amp", "<&ampx; AB&copy · &notit;&amp")
    assert parsing.parse_page("<!ENTITY x>")[0] == "rejected" and parsing.parse_page(None)[0] == "empty"


def test_hash_embedding_is_a_unit_vector():
    v = parsing.hash_embedding("some text")
    assert abs(sum(x * x for x in v) - 1) < 1e-4 and parsing.hash_embedding(None) == [0.0] * 32


def test_shared_items():
    assert parsing.parse_item("<msg><appmsg><type>5</type><title> A  b </title><url>u</url></appmsg></msg>") == ("parsed", "link", "A b", "u")
    assert parsing.parse_item("<msg><appmsg><type>77</type></appmsg></msg>")[0] == "unsupported"
    assert [parsing.parse_item(x)[0] for x in ("<a", "<!DOCTYPE x><a/>", None, "<msg/>")] == ["malformed", "rejected", "empty", "unsupported"]


def test_floor_is_just_above_the_negatives():
    assert ranking.calibrated_floor(0.5, 0.4) is None and ranking.calibrated_floor(None, 1.0) is None
    f = ranking.calibrated_floor(0.25, 0.5)
    assert 0.25 < f < 0.25 + 1e-12


def test_hash_embedding_query_has_every_chunk(spark):
    folder = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.chunk_index): [int(x) / 1_000_000 for x in r.embedding.split(",")] for r in QUERIES["hash_embedding_udf"](spark, folder).collect()}
    want = {(r.doc_id, i): parsing.hash_embedding(c) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() for i, c in enumerate(parsing.chunk(r.text) or [])}
    assert got == want


def test_context_meets_only_wanted_rows(spark):
    df = spark.createDataFrame([(c, i * 10) for c in (1, 2) for i in range(60 if c == 1 else 2)], "c long, o long")
    out = windows.context_of(df, df.filter("o % 50 = 0"), "c", "o", 2, 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Join" in x and ">=" in x], plan
    want = sorted((c, a * 10, n * 10, n - a) for c, size in ((1, 60), (2, 2)) for a in range(0, size, 5) for n in range(max(0, a - 2), min(size, a + 2)))
    assert sorted((r.c, r.anchor, r.o, r.offset) for r in out.collect()) == want


def test_a_key_over_several_ranges_has_the_same_sessions_and_numbers(spark):
    import random
    from datetime import datetime, timedelta

    rnd = random.Random(4)
    rows, at = [], datetime(2024, 1, 1)
    for i in range(3000):
        at += timedelta(seconds=rnd.choice([1, 5, 60, 4000]))
        rows.append((i, 1 if rnd.random() < 0.9 else rnd.randrange(2, 6), at))
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    spread = windows.spread_sessions(e, ["user_id"], "ts", "event_id", 3600)
    want = windows.with_sessions(e, ["user_id"], "ts", "event_id", 3600)
    key = lambda df: sorted((r.event_id, r.user_id, r.new_session, r.session_no) for r in df.collect())
    assert key(spread) == key(want)
    numbers = windows.spread_numbers(e, ["user_id"], ["ts", "event_id"])
    again = windows.resequenced(e, ["user_id"], F.asc("ts"), F.asc("event_id"), into="n")
    assert sorted(map(tuple, numbers.select("event_id", "n").collect())) == sorted(map(tuple, again.select("event_id", "n").collect()))
    assert windows._dealt(e, ["user_id"], ["ts", "event_id"]).filter("user_id = 1").select("__range").distinct().count() > 1
    assert windows.spread_sessions(e.limit(0), ["user_id"], "ts", "event_id", 3600).count() == 0


def test_use_is_priced_by_model_and_time(spark):
    import datetime as dt

    from evidara.operators.evidence import priced

    at = lambda day: dt.datetime(2024, 1, day)
    rows = [("a", at(1), 10), ("a", at(5), 10), ("a", at(5), None), ("b", at(1), 7), ("c", at(9), 3), (None, at(9), 4), ("a", None, 2)]
    use = spark.createDataFrame(rows, "model string, at timestamp_ntz, tokens long")
    got = {r.model: tuple(r)[1:] for r in priced(use, [("a", "2024-01-05", 3), ("a", "2024-01-01", 2), ("b", "2024-01-02", 9)]).collect()}
    assert got == {"a": (4, 22, 1, 50), "b": (1, 7, 1, 0), "c": (1, 3, 1, 0), None: (1, 4, 1, 0)}
    assert priced(use.limit(0), []).count() == 0
