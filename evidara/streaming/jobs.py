"""Structured Streaming forms of the incremental operators.

Each job reads a stream of events and has a batch twin in the catalog; checkpoints and
results lie in folders that the caller names, on storage that all machines share.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import incremental as I

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A file stream of event tables; ts becomes a UTC timestamp, which watermarks need."""
    s = spark.readStream.schema(EVENTS)
    s = (s.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else s).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, written as Parquet, in as many batches as the source cuts."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_upserts(events: DataFrame, root: str, checkpoint: str, keys: list[str]) -> None:
    """Keyed upsert of each micro-batch into a table in buckets under root: the latest row of each key.

    Work and what is written are in proportion to the buckets that a batch changes. A batch that
    ran before is met again after a failure; it then changes nothing, and no version is written.
    """

    mark = F.struct("ts", "event_id")

    def newest(new: DataFrame, held: DataFrame | None) -> DataFrame:
        if held is None:
            return new
        marks = held.select(*keys, mark.alias("__mark"))  # a batch may come after one with later rows
        return new.join(marks, keys, "left").filter(F.col("__mark").isNull() | (mark >= F.col("__mark"))).drop("__mark")

    def put(batch: DataFrame, _: int) -> None:
        table = I.BucketTable(batch.sparkSession, root, keys)
        new = I.last_wins(batch, keys, F.struct("ts", "event_id")).persist()
        try:
            table.merge(lambda held: newest(new, held))
        finally:
            new.unpersist()

    events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "28800 seconds", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return s.select("user_id", F.col("w.start").alias("session_start"), "last_ts", "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


# The least and greatest wait, and what each event and a purchase add to it.
def quiet_seconds(count: int, last_kind: str) -> float:
    """How long to wait after an event before a round is taken as over: longer after many events, and after a purchase."""
    return min(1800.0, 300.0 + 60.0 * min(count, 10) + (600.0 if last_kind == "purchase" else 0.0))


ROUND = "user_id long, first_event long, last_event long, n long, started timestamp, ended timestamp, closed_by string"
_STATE = "first_event long, last_event long, n long, started double, ended double, kind string"


def fold_rounds(events: list[tuple[int, float, str]], state: tuple | None, cap_seconds: float) -> tuple[list[tuple], tuple | None]:
    """Rounds that events (id, seconds, kind; in order) close, and the open one.

    An event at or before the last place is dropped; one after the quiet time, or beyond the cap
    since the start, closes the round and begins another.
    """
    closed = []
    for i, at, kind in events:
        if state:
            first, last, n, started, ended, before = state
            if (at, i) <= (ended, last):
                continue
            quiet, full = at - ended >= quiet_seconds(n, before), at - started >= cap_seconds
            if not quiet and not full:
                state = (first, i, n + 1, started, at, kind)
                continue
            closed.append((first, last, n, started, ended, "quiet" if quiet else "cap"))
        state = (i, i, 1, at, at, kind)
    return closed, state


def adaptive_rounds(events: DataFrame, late: str = "1 hour", cap_seconds: float = 7200.0) -> DataFrame:
    """Rounds of a user's events whose quiet time depends on their number and last kind, with a greatest length.

    State is one open round per user; event-time timers close rounds that go quiet. Rows without a time or id are
    left out. Start it within rounds.state_on_disk.
    """
    e = events.filter("ts IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", late).select("user_id", "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"), "event_type")
    return e.groupBy("user_id").transformWithState(AdaptiveRounds(cap_seconds), ROUND, "append", "eventtime")


class AdaptiveRounds(StatefulProcessor):
    """The timer of a user's open round is kept with it, so that it need not be asked for."""

    def __init__(self, cap_seconds: float):
        self.cap_seconds = cap_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"{_STATE}, timer long")

    def rows(self, key: tuple, closed: list[tuple]) -> Iterator[Row]:
        at = lambda s: datetime.fromtimestamp(0, timezone.utc) + timedelta(seconds=s)
        for first, last, n, started, ended, why in closed:
            yield Row(user_id=key[0], first_event=first, last_event=last, n=n, started=at(started), ended=at(ended), closed_by=why)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.open.get()
        events = sorted(((r["event_id"], r["at"], r["event_type"]) for r in rows), key=lambda e: (e[1], e[0]))
        closed, now = fold_rounds(events, held[:6] if held else None, self.cap_seconds)
        if now != (held[:6] if held else None):
            timer = max(int((now[4] + quiet_seconds(now[2], now[5])) * 1000), timerValues.getCurrentWatermarkInMs() + 1)
            self.open.update((*now, timer))
            if held and held[6] != timer:
                self.handle.deleteTimer(held[6])
            if not held or held[6] != timer:
                self.handle.registerTimer(timer)
        return self.rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.open.get()
        if not held or held[6] != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        self.open.clear()
        return self.rows(key, [(*held[:5], "quiet")])

    def close(self) -> None:
        pass
