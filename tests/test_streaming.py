"""Streams give what their batch twins give."""

from pyspark.sql import functions as F

from evidara.catalog import messages, streams
from evidara.operators.windows import epoch
from evidara.sources import tables as S
from evidara.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def test_tumbling_equals_batch_up_to_the_watermark(spark):
    got = {(r.window_start, r.event_type): r.n for r in streams.stream_tumbling(spark, FOLDER).collect()}
    want = {(r.window_start, r.event_type): r.n for r in messages.events_tumbling(spark, FOLDER).collect()}
    last = max(t for t, _ in got)
    assert got and got == {k: n for k, n in want.items() if k[0] <= last}
    assert len(got) > 0.9 * len(want)


def test_dedupe_keeps_each_event_once(spark):
    assert streams.stream_dedupe(spark, FOLDER).count() == S.raw(spark, FOLDER, "events").select("event_id").distinct().count()


def test_rounds_equal_a_fold_over_each_user(spark):
    got = sorted((r.user_id, r.first_event, r.last_event, r.n) for r in streams.stream_rounds(spark, FOLDER).collect())
    rows = S.raw(spark, FOLDER, "events").select("user_id", "event_id", epoch("ts").alias("at"), "event_type").orderBy("ts", "event_id").collect()
    want = []
    for user in {r.user_id for r in rows}:
        closed, _ = jobs.fold_rounds([(r.event_id, r["at"], r.event_type) for r in rows if r.user_id == user], None, 7200.0)
        want += [(user, *c[:3]) for c in closed]
    assert set(want) - set(got) == set()  # a timer may also close the last round of a user
    assert len(got) <= len(want) + len({r.user_id for r in rows})


def test_fold_drops_what_came_before_and_caps():
    closed, state = jobs.fold_rounds([(1, 0.0, "view"), (2, 100.0, "view"), (1, 50.0, "view"), (3, 250.0, "view")], None, 200.0)
    assert closed == [(1, 2, 2, 0.0, 100.0, "cap")] and state[:3] == (3, 3, 1)


def test_upserts_twice_write_nothing_new(spark, tmp_path):
    from evidara.operators.incremental import BucketTable

    e = S.raw(spark, FOLDER, "events").limit(50)
    e.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        jobs.run_upserts(jobs.read_events(spark, str(tmp_path / "in")).select("user_id", "event_id", "ts", "event_type"), str(tmp_path / "t"), str(tmp_path / f"cp{k}"), ["user_id"])
    table = BucketTable(spark, str(tmp_path / "t"), ["user_id"])
    assert table.version() == 1 and table.read().count() == e.agg(F.countDistinct("user_id")).first()[0]


def test_an_upsert_writes_the_buckets_it_changes(spark, tmp_path):
    from evidara.operators.incremental import BucketTable

    table = BucketTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    df = lambda rows: spark.createDataFrame(rows, "k long, v string")
    assert table.read() is None and len(table.upsert(df([(i, "a") for i in range(100)]))) == 8
    one = table.upsert(df([(7, "b"), (8, "a")]))
    assert len(one) == 1 and sorted(table.manifest().values()).count(2) == 1
    assert table.upsert(df([(7, "b")])) == [] and table.version() == 2
    assert {r.k: r.v for r in table.read().collect()} == {i: "b" if i == 7 else "a" for i in range(100)}
    table.upsert(df([(1000, "n")]))
    assert table.read().count() == 101
    before = {tuple(r) for r in table.read().select("k", "v").collect()}
    assert table.vacuum() >= 1 and {tuple(r) for r in table.read().select("k", "v").collect()} == before
    assert table.vacuum() == 0


def test_generations(spark, tmp_path):
    import pytest

    from evidara.operators.incremental import Generations

    g = Generations(spark, str(tmp_path / "g"))
    assert g.read() is None
    one, two = g.begin(), g.begin()
    g.write(one, spark.range(3))
    with pytest.raises(ValueError):
        g.activate(two)
    g.activate(one)
    spark.range(9).write.parquet(str(tmp_path / "g" / "build=2"))  # left half-made
    assert g.read().count() == 3 and g.recover() == [two] and not (tmp_path / "g" / "build=2").exists()
    three = g.begin()
    g.write(three, spark.range(5))
    g.activate(three)
    assert g.states() == {one: "retired", two: "failed", three: "active"} and g.read().count() == 5
    with pytest.raises(ValueError):
        g.write(three, spark.range(1))
