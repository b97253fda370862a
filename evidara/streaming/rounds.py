"""Rounds of a user's messages with drafts by revision, superseded drafts, retries and expiry.

A message opens a round, or is the next revision of the open one. A revision has a draft
once the user was quiet for a short time; a later message supersedes it and clears what was
retried. Failures (events of one kind) put the round off, longer each time, and block it at
the last attempt; a message unblocks it. A round is ready once it was quiet for long enough
or has reached its greatest length, and one that stays blocked expires. When a round ends,
each of its drafts is told with its outcome.

State of a user is four variables: the open round, its drafts by revision, its retries, and
the last place, which tells events that come late, with the timer that is set; it is dropped
behind the watermark. Each access is a message to the JVM, so what is not there is not asked
for, and what did not change is not written.
Defined cases: events at or before the last place are told as `late` and change nothing,
repeated ones too; failures without an open round do nothing; rows with a null user, time
or id are left out; a null kind is a message.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Timing:
    """All in seconds; longer says which kind of last message makes the quiet time longer, failure which events fail."""

    prepare: float = 3600.0
    quiet: float = 21600.0
    per_message: float = 3600.0
    counted: int = 6
    longer: str = "purchase"
    longer_by: float = 14400.0
    greatest: float = 172800.0
    back_off: float = 7200.0
    most_back_off: float = 86400.0
    attempts: int = 3
    expire: float = 345600.0
    failure: str = "error"


class Round(NamedTuple):
    first_event: int
    last_event: int  # the message of the present revision
    revision: int
    started: float
    ended: float
    kind: str | None

    def prepared_at(self, t: Timing) -> float:
        return min(self.started + t.greatest, self.ended + t.prepare)

    def due_at(self, t: Timing, retry: Retry) -> float:
        if retry.blocked:
            return self.ended + t.expire
        quiet = t.quiet + t.per_message * min(self.revision, t.counted) + (t.longer_by if self.kind == t.longer else 0.0)
        return max(min(self.started + t.greatest, self.ended + quiet), retry.not_before)


class Retry(NamedTuple):
    attempts: int = 0
    not_before: float = 0.0
    blocked: bool = False

    def failed(self, at: float, t: Timing) -> Retry:
        n = self.attempts + 1
        return Retry(n, at + min(t.most_back_off, t.back_off * 2 ** (n - 1)), n >= t.attempts)


class Draft(NamedTuple):
    last_event: int
    made: float
    attempts: int


DRAFT = "user_id long, first_event long, last_event long, revision long, attempts long, outcome string, seconds double"
COLUMNS = [c.split()[0] for c in DRAFT.split(", ")]


class Held:
    """What is held of one user; a processor loads it from state variables and stores it there again."""

    def __init__(self, round_: Round | None = None, drafts: dict[int, Draft] | None = None, retry: Retry = Retry(), place: tuple[float, int] | None = None):
        self.round, self.drafts, self.retry, self.place = round_, drafts or {}, retry, place

    def draft(self, t: Timing, now: float) -> None:
        if self.round and self.round.prepared_at(t) <= now:
            self.drafts[self.round.revision] = Draft(self.round.last_event, self.round.prepared_at(t), self.retry.attempts)

    def until(self, now: float, t: Timing) -> list[tuple]:
        """What is due by now: rows of drafts of a round that ends."""
        self.draft(t, now)
        r = self.round
        if not r or r.due_at(t, self.retry) > now:
            return []
        self.draft(t, max(now, r.prepared_at(t)))
        end = "expired" if self.retry.blocked else "ready"
        out = [(r.first_event, d.last_event, n, d.attempts, end if n == r.revision else "superseded", d.made - r.started) for n, d in sorted(self.drafts.items())]
        self.round, self.drafts, self.retry = None, {}, Retry()
        return out

    def observe(self, i: int, at: float, kind: str | None, t: Timing) -> list[tuple]:
        if self.place and (at, i) <= self.place:
            return [(None, i, 0, 0, "late", 0.0)]
        out = self.until(at, t)
        self.place = (at, i)
        if kind == t.failure:
            self.retry = self.retry.failed(at, t) if self.round else self.retry
        elif self.round:
            r = self.round
            self.round, self.retry = Round(r.first_event, i, r.revision + 1, r.started, at, kind), Retry()
        else:
            self.round = Round(i, i, 1, at, at, kind)
        return out


class Rounds(StatefulProcessor):
    """Timers are set to when a draft is prepared, a round is due, or the last place is behind the watermark."""

    def __init__(self, timing: Timing):
        self.timing = timing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_event long, last_event long, revision long, started double, ended double, kind string")
        self.drafts = handle.getMapState("drafts", "revision long", "last_event long, made double, attempts long")
        self.retry = handle.getValueState("retry", "attempts long, not_before double, blocked boolean")
        self.place = handle.getValueState("place", "at double, event_id long, timer long")

    def load(self) -> Held:
        place, open_ = self.place.get(), self.open.get()
        retry = self.retry.get() if open_ else None
        drafts = {k[0]: Draft(*v) for k, v in self.drafts.iterator()} if open_ else {}
        self.timer = place[2] if place else None
        held = Held(Round(*open_) if open_ else None, drafts, Retry(*retry) if retry else Retry(), tuple(place[:2]) if place else None)
        self.before = self.values(held, self.timer), dict(drafts)
        return held

    def values(self, held: Held, timer: int | None) -> tuple[tuple | None, ...]:
        """What is held, as values of the states open, retry and place."""
        return held.round, held.retry if held.round and held.retry.attempts else None, (*held.place, timer) if held.place else None

    def wanted(self, held: Held, watermark: int) -> int | None:
        """The time of the next timer, in milliseconds; there is none without a last place."""
        if held.round:
            at = held.round.due_at(self.timing, held.retry)
            at = at if held.round.revision in held.drafts else min(held.round.prepared_at(self.timing), at)
        elif held.place:
            at = held.place[0] + 1
        else:
            return None
        return max(int(-(-at * 1000 // 1)), watermark + 1)

    def store(self, held: Held, watermark: int, expired: int | None = None) -> None:
        """expired is the timer that goes when this is done."""
        timer = self.wanted(held, watermark)
        values, drafts = self.before
        for state, was, now in zip((self.open, self.retry, self.place), values, self.values(held, timer)):
            if now is None and was is not None:
                state.clear()
            elif now != was:
                state.update(tuple(now))
        for n in drafts.keys() - held.drafts.keys():
            self.drafts.removeKey((n,))
        for n, d in held.drafts.items():
            if drafts.get(n) != d:
                self.drafts.updateValue((n,), tuple(d))
        if timer != self.timer:
            if self.timer not in (None, expired):
                self.handle.deleteTimer(self.timer)
            if timer is not None:
                self.handle.registerTimer(timer)

    def rows(self, key: tuple, out: list[tuple]) -> Iterator[Row]:
        return (Row(**dict(zip(COLUMNS, (key[0], *row)))) for row in out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, out = self.load(), []
        for at, i, kind in sorted(((r["at"], r["event_id"], r["event_type"]) for r in rows), key=lambda e: e[:2]):
            out += held.observe(i, at, kind, self.timing)
        self.store(held, timerValues.getCurrentWatermarkInMs())
        return self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, watermark = self.load(), timerValues.getCurrentWatermarkInMs()
        out = held.until(watermark / 1000, self.timing)
        if not held.round and held.place and held.place[0] * 1000 < watermark:
            held.place = None  # what comes before the watermark is not seen any more
        self.store(held, watermark, expiredTimerInfo.getExpiryTimeInMs())
        return self.rows(key, out)

    def close(self) -> None:
        pass


def drafted_rounds(events: DataFrame, late: str = "1 hour", timing: Timing = Timing()) -> DataFrame:
    """DRAFT rows of a stream of events (user_id, event_id, ts timestamp, event_type); start it, and read its state, within state_on_disk."""
    known = events.filter("user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", late)
    e = known.select("user_id", "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"), "event_type")
    return e.groupBy("user_id").transformWithState(Rounds(timing), DRAFT, "append", "eventtime")


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State of several variables needs the store that keeps it on disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def open_rounds(spark: SparkSession, checkpoint: str) -> DataFrame:
    """user_id, first_event, revision, attempts and blocked of the rounds that the last batch left open, read from the state."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    r = read("open").select("key.user_id", "value.first_event", "value.revision")
    retry = read("retry").select("key.user_id", "value.attempts", "value.blocked")
    return r.join(retry, "user_id", "left").fillna(0, ["attempts"]).fillna(False, ["blocked"])
