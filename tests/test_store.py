"""Commits of several writers, of writers that died, and of queues."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest

from evidara.operators.queue import RefreshQueue
from evidara.operators.store import Change, Generation, Store, put_if_absent

ROW = "k long, v string"


@pytest.fixture
def rows(spark):
    return lambda r: spark.createDataFrame(r, ROW)


def content(version, table="t"):
    return {r.k: r.v for r in version.read(table).collect()}


def test_only_one_puts(spark, tmp_path):
    path = str(tmp_path / "log" / "1")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: put_if_absent(spark, path, str(i)), range(8)))
    assert sum(won) == 1 and open(path).read() == str(won.index(True))


@pytest.mark.parametrize("split", [0, 4])
def test_writers_at_the_same_time_lose_nothing(spark, tmp_path, rows, split):
    store = Store(spark, str(tmp_path), split=split)
    store.commit({"t": Change(rows([(i, "old") for i in range(20)]))}, {"t": ["k"]})

    def write(i):
        return store.commit({"t": Change(rows([(i, f"w{i}"), (100 + i, "new")]))})

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(4)))
    assert sorted(c.version for c in done) == [2, 3, 4, 5]
    assert content(store.version()) == {**{i: "old" for i in range(20)}, **{i: f"w{i}" for i in range(4)}, **{100 + i: "new" for i in range(4)}}
    assert all(c.counts["t"] == {"changed": 1, "inserted": 1} for c in done)


def test_a_plan_runs_again_on_what_came_first(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path))
    store.commit({"t": Change(rows([(1, "0")]))}, {"t": ["k"]})
    other = iter([True])

    def plan(v):
        n = int(v.read("t").first().v)
        if next(other, False):  # another writer is faster, once
            store.commit({"t": Change(rows([(1, str(n + 10))]))})
        return {"t": Change(rows([(1, str(n + 1))]))}

    store.commit(plan, reads=["t"])
    assert content(store.version()) == {1: "11"}


def test_a_writer_that_died_before_its_entry_leaves_nothing_to_read(spark, tmp_path, rows, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.commit({"t": Change(rows([(1, "a")]))}, {"t": ["k"]})
    with monkeypatch.context() as m:
        m.setattr(Store, "_put", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.commit({"t": Change(rows([(1, "b"), (2, "b")]))})
    assert content(store.version()) == {1: "a"}
    assert store.vacuum(older_than=3600) == 0 and store.vacuum() == 1
    store.commit({"t": Change(rows([(2, "c")]))})
    assert content(store.version()) == {1: "a", 2: "c"}


def test_replays_and_equal_rows_write_nothing(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path))
    batch = {"t": Change(rows([(1, "a"), (2, None)]))}
    assert store.commit(batch, {"t": ["k"]}, once=("feed", 7)).version == 1
    assert store.commit({"t": Change(rows([(3, "x")]))}, once=("feed", 7)) == (1, {}, {})
    again = store.commit(batch)
    assert again.version == 1 and again.counts == {"t": {"unchanged": 2}} and again.written == {}
    gone = store.commit({"t": Change(deletes=spark.createDataFrame([(2,), (9,)], "k long"))})
    assert gone.counts == {"t": {"deleted": 1}} and content(store.version()) == {1: "a"}
    empty = store.commit({"t": Change(deletes=spark.createDataFrame([(1,)], "k long"))})
    assert empty.counts == {"t": {"deleted": 1}} and content(store.version()) == {} and content(store.version(1)) == {1: "a", 2: None}


def test_full_parts_are_split_and_only_touched_ones_written(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path), part_rows=50)
    for k in range(4):
        store.commit({"t": Change(rows([(i, f"{k}") for i in range(k * 100, k * 100 + 100)]))}, {"t": ["k"]})
    v = store.version()
    parts = v.tables["t"].parts
    assert len(parts) >= 8 and sum(p.rows for p in parts.values()) == 400 and max(p.rows for p in parts.values()) <= 100
    assert content(v) == {i: str(i // 100) for i in range(400)}
    one = store.commit({"t": Change(rows([(7, "x")]))})
    assert len(one.written["t"]) == 1 and content(store.version())[7] == "x" and content(v)[7] == "0"
    assert len(store.version().part("t", one.written["t"]).collect()) == store.version().tables["t"].parts[one.written["t"][0]].rows


def test_generations_are_claimed_by_one(spark, tmp_path):
    g = Generation(spark, str(tmp_path))
    with ThreadPoolExecutor(4) as pool:
        got = [x for x in pool.map(lambda _: g.claim(0), range(4)) if x]
    assert got == [1] and g.read() == 1 and g.claim(1) is None and g.claim(0) is None
    assert g.complete(1) == 2 and g.claim(2) == 3
    assert g.recover() == 4 and g.recover() == 4
    with pytest.raises(RuntimeError):
        g.complete(3)
    with pytest.raises(ValueError):
        g.complete(4)


def test_queue(spark, tmp_path):
    q = RefreshQueue(Store(spark, str(tmp_path)))
    t0 = datetime(2024, 1, 1)
    at = lambda m: t0 + timedelta(minutes=m)
    q.enqueue(spark.createDataFrame([(1, at(5)), (1, at(1)), (2, at(2)), (3, at(90))], "entity long, due timestamp_ntz"))
    q.enqueue(spark.createDataFrame([(2, at(9)), (3, at(3))], "entity long, due timestamp_ntz"))
    assert {r.entity: r.due for r in q.read().collect()} == {1: at(1), 2: at(2), 3: at(3)}
    assert q.claim(at(2), 60, limit=5) == [(1, 1), (2, 1)] and q.claim(at(2), 60, limit=5) == []
    again = q.claim(at(4), 60, limit=5)  # leases ran out
    assert again == [(1, 2), (2, 2), (3, 1)]
    q.settle(done=[(1, 1), (2, 2)], failed=[(3, 1)], now=at(4))  # the first claim of 1 does not hold any more
    assert {(r.entity, r.attempts, r.state, r.due) for r in q.read().collect()} == {(1, 0, "pending", at(1)), (3, 1, "pending", at(4.5))}
    assert q.drain(lambda e: e == 1 or 1 / 0, at(10)) == (1, 1)
    assert [(r.entity, r.attempts, r.state) for r in q.read().collect()] == [(3, 2, "pending")]
    assert q.drain(lambda e: False, at(30)) == (0, 1) and q.read().first().state == "blocked" and q.claim(at(99)) == []


def test_two_who_claim_get_different_entries(spark, tmp_path):
    q = RefreshQueue(Store(spark, str(tmp_path)))
    t0 = datetime(2024, 1, 1)
    q.enqueue(spark.createDataFrame([(i, t0) for i in range(4)], "entity long, due timestamp_ntz"))
    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(lambda _: q.claim(t0, 60, limit=2), range(2)))
    assert sorted(e for x in got for e, _ in x) == [0, 1, 2, 3]


def test_a_part_of_many_rows_is_dealt_to_files(spark, tmp_path, rows, monkeypatch):
    """One that is large, as that of a cell may be, is not the work of one task; its rows are still one part."""
    monkeypatch.setattr("evidara.operators.store.FILE_ROWS", 10)
    store = Store(spark, str(tmp_path))
    files = lambda: {f.rsplit("/", 1)[1] for f in store.version().read("t").inputFiles()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.commit({"t": Change(rows([(i, "a") for i in range(100)]))}, {"t": ["k"]})
        assert len(store.version().tables["t"].parts) == 1 and len(files()) > 1
        store.commit({"t": Change(rows([(i, "b") for i in range(90, 110)]), spark.createDataFrame([(0,)], "k long"))})
        assert len(store.version().tables["t"].parts) == 1 and len(files()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert content(store.version()) == {i: "b" if i >= 90 else "a" for i in range(1, 110)}


def test_equal_and_different_long_values_are_told_apart(spark, tmp_path):
    """They are compared by digests; rows of a change that differs for sure are not compared at all."""
    df = lambda rows: spark.createDataFrame(rows, "k long, v string, a array<double>, n int")
    store = Store(spark, str(tmp_path))
    long, nan = "x" * 1000, float("nan")
    old = [(1, long, [1.0, None], None), (2, long, [None, 1.0], 1), (3, None, None, None), (4, "", [], 0), (5, long, [nan], 5)]
    store.commit({"t": Change(df(old))}, {"t": ["k"]})
    assert store.commit({"t": Change(df(old))}).counts["t"] == {"unchanged": 5}
    new = [(1, long, [None, 1.0], None), (2, long + "y", [None, 1.0], 1), (3, "", None, None), (4, "", None, 0), (5, long, [nan], 5), (6, None, None, None)]
    assert store.commit({"t": Change(df(new))}).counts["t"] == {"changed": 4, "unchanged": 1, "inserted": 1}
    assert sorted(map(repr, store.version().read("t").collect())) == sorted(map(repr, df(new).collect()))
    assert store.commit({"t": Change(df([(7, "z", None, 7), new[5]]), spark.createDataFrame([(1,), (9,)], "k long"), differs=True)}).counts["t"] == {"inserted": 1, "changed": 1, "deleted": 1}
    assert sorted(r.k for r in store.version().read("t").collect()) == [2, 3, 4, 5, 6, 7]
