import json
from datetime import datetime

from pyspark.sql import functions as F

from evidara.sources import readers as R


def test_jsonl_aliases_blanks_and_times(spark, tmp_path):
    rows = [
        {"room_id": "a@chatroom", "text": "one", "time": "1700000000", "id": "1", "sender": "x"},
        {"talker": "b", "message": "two", "timestamp": "1700000000123", "from": "y"},
        {"conversation_id": "c", "content": "  ", "ts": "2024-01-01T00:00:00Z"},
        {"conversation_id": "c", "body": "bad time", "ts": "when"},
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r.content: r for r in R.read_jsonl(spark, str(tmp_path / "x.jsonl"), "acc").collect()}
    assert set(got) == {"one", "two", "bad time"}
    assert (got["one"].conversation_type, got["two"].conversation_type) == ("group", "private")
    assert got["one"].timestamp == datetime(2023, 11, 14, 22, 13, 20)
    assert got["two"].timestamp == datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert got["bad time"].timestamp == datetime(1970, 1, 1)
    assert {r.account_id for r in got.values()} == {"acc"}


def test_archive_tables(spark):
    a = spark.createDataFrame([("c", "hi", "1")], "Talker string, Message string, ID string")
    b = spark.createDataFrame([("c", "ho", "2")], "chat_id string, body string, msg_id string")
    other = spark.createDataFrame([("z",)], "text string")
    out = R.union_archive({"message_1": a, "MSG": b, "contacts": other})
    assert sorted((r.shard_id, r.content, r.local_id) for r in out.collect()) == [("MSG", "ho", "2"), ("message_1", "hi", "1")]


def test_waterlines_tell_late_rows(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 5, 30), ("a", 2, 40), ("b", 1, 1)], "k string, id int, t int")
    marks = spark.createDataFrame([("a", 3, 20)], "k string, max_local int, max_time int")
    got = {(r.k, r.id): r.late for r in R.newer_than(rows, marks, ["k"], "id", "t").collect()}
    assert got == {("a", 1): True, ("a", 5): False, ("a", 2): False, ("b", 1): False}


def test_eval_pack_of_both_versions(spark, tmp_path):
    rows = [{"id": "1", "query": "q", "expected_citation": "m/1"}, {"schema_version": 2, "case_id": "2", "query": "r", "limit": 5, "oracle": {"expected_any_citation": '["a","b"]'}}, {"case_id": "3", "query": " "}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r.case_id: (r.limit, r.expected) for r in R.read_eval_pack(spark, str(tmp_path / "p.jsonl")).collect()}
    assert got == {"1": (10, ["m/1"]), "2": (5, ["a", "b"])}


def test_listing_digest_ignores_order(spark):
    rows = [("a", 1, 5), ("b", 2, 6)]
    d = [R.listing_digest(spark.createDataFrame(r, "path string, length long, modificationTime long")).first() for r in (rows, rows[::-1], rows[:1])]
    assert d[0] == d[1] != d[2]


def test_fixture_and_first_wins(spark):
    m = R.fixture_messages(spark)
    assert m.count() == 12 and m.select("conversation_id").distinct().count() == 4
    assert R.first_wins(m, ["account_id"], ["timestamp"]).count() == 2
    assert m.filter(F.col("local_id") == 0).select("shard_id").distinct().count() == 2


def test_ticks_tell_what_changed(spark):
    df = lambda rows: spark.createDataFrame(rows, "path string, length long, modificationTime long")
    a, b = df([("a", 1, 5), ("b", 2, 6)]), df([("a", 1, 5), ("b", 3, 7), ("c", 1, 1)])
    of = lambda r: (r.changed, r.event_loss, r.scan_complete, r.added, r.altered, r.removed, r.files)
    assert of(R.tick(None, a).first()) == (True, False, True, 2, 0, 0, 2)
    assert of(R.tick(a, a).first()) == (False, False, True, 0, 0, 0, 2)
    assert of(R.tick(a, b).first()) == (True, False, True, 1, 1, 0, 3)
    assert of(R.tick(b, a).first()) == (True, False, True, 0, 1, 1, 2)
    assert of(R.tick(b, a.limit(1), complete=False).first()) == (False, True, False, 0, 0, 0, 1)
    assert [R.poll_seconds(n) for n in (0, 1, 5, 9, 400)] == [1, 2, 32, 300, 300]


def test_change_batches(spark):
    import pytest

    rows = spark.createDataFrame([("x", 1), ("x", 2), ("x", 5), ("y", 2)], "account_id string, change_id long")
    batch = R.ChangeBatch("x", rows, 4, 1)
    assert [r.change_id for r in batch.records.collect()] == [2] and not batch.replayed
    assert sorted(map(tuple, batch.problems(rows).collect())) == [("x", 5), ("y", 2)]
    again = R.ChangeBatch("x", rows, 4, 4)
    assert again.replayed and again.records.count() == 0
    for bad in (lambda: R.ChangeBatch("", rows, 1), lambda: R.ChangeBatch("x", rows, -1), lambda: R.ChangeBatch("x", rows.drop("change_id"), 1)):
        with pytest.raises(ValueError):
            bad()
