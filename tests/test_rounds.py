"""Rounds with drafts: the steps on their own, and a stream with late rows, stops and expiry."""

import datetime as dt

from evidara.streaming import jobs, rounds
from evidara.streaming.rounds import Held, Timing

T = Timing(prepare=10, quiet=100, per_message=0, longer_by=0, greatest=500, back_off=20, most_back_off=1000, expire=1000)


def told(events, timing=T, until=None):
    held, out = Held(), []
    for e in events:
        out += held.observe(*e, timing)
    return out + (held.until(until, timing) if until is not None else []), held


def test_a_message_supersedes_the_draft_before_it():
    out, held = told([(1, 0.0, "view"), (2, 20.0, "view"), (3, 25.0, "view")], until=200.0)
    assert out == [(1, 1, 1, 0, "superseded", 10.0), (1, 3, 3, 0, "ready", 35.0)]  # revision 2 had no time for a draft
    assert held.round is None and held.drafts == {} and held.place == (25.0, 3)


def test_failures_put_off_block_and_expire():
    out, held = told([(1, 0.0, "view"), (2, 90.0, "error")])
    assert out == [] and held.retry == (1, 110.0, False) and held.until(109.0, T) == []
    assert held.until(110.0, T) == [(1, 1, 1, 1, "ready", 10.0)]
    blocked = [(1, 0.0, "view"), (2, 90.0, "error"), (3, 95.0, "error"), (4, 96.0, "error")]
    out, held = told(blocked)
    assert held.retry.blocked and held.until(999.0, T) == [] and held.until(1000.0, T) == [(1, 1, 1, 3, "expired", 10.0)]
    out, held = told([*blocked, (5, 200.0, "view")])
    assert held.retry == (0, 0.0, False) and held.round.revision == 2 and held.until(300.0, T)[-1] == (1, 5, 2, 0, "ready", 210.0)


def test_length_late_rows_and_failures_without_a_round():
    out, held = told([(9, 0.0, "error")] + [(i, i * 90.0, "view") for i in range(1, 8)])
    ends = [r for r in out if r[4] == "ready"]
    assert [(r[0], r[1]) for r in ends] == [(1, 6)]  # 500 seconds after 90 a round ends, and the next message opens another
    out, held = told([(5, 50.0, "view"), (5, 50.0, "view"), (4, 50.0, "view"), (6, 49.0, "error"), (7, 51.0, None)])
    assert [r[1] for r in out if r[4] == "late"] == [5, 4, 6] and held.round.revision == 2 and held.retry.attempts == 0


def test_stream_equals_the_steps_with_late_rows_and_stops(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = lambda part: [(i, t0 + dt.timedelta(seconds=s), u, k, 0.0, "") for i, s, u, k in part]
    parts = [
        [(1, 0, 1, "view"), (2, 5000, 1, "view"), (3, 100, 2, "view"), (4, 200, 2, "error"), (5, 300, 2, "error"), (6, 400, 2, "error"), (20, 0, None, "view")],
        [(7, 4000, 1, "view"), (2, 5000, 1, "view"), (8, 6000, 1, "purchase"), (9, 6000, 3, None)],
        [(10, 700000, 3, "view")],
        [(11, 710000, 3, "view"), (12, 1, 1, "view")],  # the last is behind the watermark, and is not seen
    ]
    for part in parts:
        spark.createDataFrame(rows(part), jobs.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with rounds.state_on_disk(spark):
            jobs.run_available(rounds.drafted_rounds(jobs.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    with rounds.state_on_disk(spark):
        held = [tuple(r) for r in rounds.open_rounds(spark, str(tmp_path / "cp")).collect()]
        places = spark.read.format("statestore").option("stateVarName", "place").load(str(tmp_path / "cp")).select("key.user_id").collect()
    got = sorted((tuple(r) for r in spark.read.schema(rounds.DRAFT).parquet(str(tmp_path / "out")).collect()), key=repr)
    want = []
    for user in (1, 2, 3):
        h = Held()
        for i, s, u, k in sum(parts[:3], []) + parts[3][:1]:
            if u == user:
                want += [(user, *r) for r in h.observe(i, t0.replace(tzinfo=dt.timezone.utc).timestamp() + s, k, Timing())]
        want += [(user, *r) for r in h.until(t0.replace(tzinfo=dt.timezone.utc).timestamp() + 706400, Timing())]
    assert got == sorted(want, key=repr)
    assert {r[5] for r in got} == {"late", "superseded", "ready", "expired"}
    assert held == [(3, 10, 2, 0, False)]
    assert [r.user_id for r in places] == [3]  # those of quiet users are dropped


class Handle:
    """States and timers in memory, with a list of what was written."""

    def __init__(self):
        self.held, self.timers, self.written = {}, set(), []

    def getValueState(self, name, schema):
        return State(self, name)

    def getMapState(self, name, key, schema):
        return State(self, name)

    def registerTimer(self, at):
        self.written.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def get(self):
        return self.handle.held.get(self.name)

    def update(self, value):
        self.handle.written.append(self.name)
        self.handle.held[self.name] = value

    def clear(self):
        self.handle.written.append(self.name)
        del self.handle.held[self.name]

    def iterator(self):
        return iter(())


class Now:
    def getCurrentWatermarkInMs(self):
        return 0

    def getExpiryTimeInMs(self):
        return 3700000


def test_only_what_changes_is_written():
    """Each access to state is a message, so a late event writes nothing, and a timer is set anew only where its time is another."""
    from pyspark.sql import Row

    for processor, written in ((rounds.Rounds(rounds.Timing()), ["open", "place", "timer"]), (jobs.AdaptiveRounds(7200.0), ["open", "timer"])):
        handle = Handle()
        processor.init(handle)
        one = Row(event_id=2, at=100.0, event_type="view")
        assert list(processor.handleInputRows((1,), iter([one]), Now())) == [] and handle.written == written
        before, handle.written = set(handle.timers), []
        late = list(processor.handleInputRows((1,), iter([one]), Now()))
        assert len(late) == (processor.__class__ is rounds.Rounds) and handle.written == [] and handle.timers == before and len(before) == 1
