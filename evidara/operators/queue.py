"""A queue of entities to be refreshed, kept in a Store: enqueue, claim, complete, fail, drain.

An entry (entity, due, lease_until, generation, attempts, state) is claimed by raising its
generation under a lease; what a claim does later, it does only while the entry has the generation that it
was given, so a claim whose lease ran out and was taken by another one changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .incremental import claimed
from .store import Change, Commit, Store, Version

TABLE = "queue"
ENTRY = "entity long, due timestamp_ntz, lease_until timestamp_ntz, generation long, attempts int, state string"
#: Attempts after which an entry is blocked, and the delay before the next one.
MOST_ATTEMPTS, DELAY_SECONDS, MOST_DELAY_SECONDS = 3, 30, 300


class RefreshQueue:
    def __init__(self, store: Store):
        self.store = store

    def read(self, version: Version | None = None) -> DataFrame:
        rows = (version or self.store.version()).read(TABLE)
        return self.store.spark.createDataFrame([], ENTRY) if rows is None else rows

    def _commit(self, plan: Callable[[DataFrame], Change], **how) -> Commit:
        return self.store.commit(lambda v: {TABLE: plan(self.read(v))}, keys={TABLE: ["entity"]}, **how)

    def enqueue(self, wanted: DataFrame) -> Commit:
        """Entities (entity, due), any number of times: the earliest due time of an entity holds, also over a pending entry."""

        def plan(held: DataFrame) -> Change:
            first = wanted.groupBy("entity").agg(F.min("due").alias("__due"))
            j = first.join(held, "entity", "left")
            pending = F.coalesce(F.col("state") == "pending", F.lit(False))
            rows = j.select(
                "entity",
                F.when(pending, F.least("due", "__due")).otherwise(F.col("__due")).alias("due"),
                "lease_until",
                F.coalesce("generation", F.lit(0)).cast("long").alias("generation"),
                F.when(pending, F.col("attempts")).otherwise(F.lit(0)).cast("int").alias("attempts"),
                F.lit("pending").alias("state"),
            )
            return Change(rows)

        return self._commit(plan, reads=[TABLE])

    def claim(self, now: datetime, lease_seconds: int = 300, limit: int = 1) -> list[tuple[int, int]]:
        """Entities whose time has come, the earliest first, with the generation each is claimed under."""
        got: list[tuple[int, int]] = []

        def plan(held: DataFrame) -> Change:
            rows = claimed(held.filter("state = 'pending'"), F.lit(now).cast("timestamp_ntz"), lease_seconds, limit)
            got[:] = [(r["entity"], r["generation"]) for r in rows.select("entity", "generation").collect()]  # at most limit
            taken = held.sparkSession.createDataFrame([(e,) for e, _ in got], "entity long")
            until = F.lit(now + timedelta(seconds=lease_seconds)).cast("timestamp_ntz")
            mine = held.join(F.broadcast(taken), "entity", "left_semi")
            return Change(mine.withColumn("lease_until", until).withColumn("generation", F.col("generation") + 1))

        self._commit(plan, reads=[TABLE])
        return got

    def settle(self, done: Iterable[tuple[int, int]] = (), failed: Iterable[tuple[int, int]] = (), now: datetime | None = None) -> Commit:
        """Takes out what was done; what failed is due again later, each time more so, and blocked after MOST_ATTEMPTS.

        Claims (entity, generation) that do not hold any more are passed over.
        """
        rows = [(e, g, False) for e, g in done] + [(e, g, True) for e, g in failed]
        spark = self.store.spark
        claims = spark.createDataFrame(rows, "entity long, generation long, failed boolean")

        def plan(held: DataFrame) -> Change:
            mine = held.join(F.broadcast(claims), ["entity", "generation"])
            tried = F.col("attempts") + 1
            rest = mine.filter("failed").select(
                "entity",
                later(F.lit(now).cast("timestamp_ntz"), tried).alias("due"),
                F.lit(None).cast("timestamp_ntz").alias("lease_until"),
                "generation",
                tried.cast("int").alias("attempts"),
                F.when(tried >= MOST_ATTEMPTS, "blocked").otherwise("pending").alias("state"),
            )
            return Change(rest, mine.filter("not failed").select("entity"))

        return self._commit(plan, reads=[TABLE])

    def drain(self, work: Callable[[int], bool], now: datetime, lease_seconds: int = 300) -> tuple[int, int]:
        """Claims one entry a poll until none is due; work says whether it went well. How many did, and did not."""
        well = ill = 0
        while got := self.claim(now, lease_seconds):
            try:
                good = work(got[0][0])
            except Exception:  # an entry that cannot be worked on is one that failed
                good = False
            self.settle(got if good else (), () if good else got, now)
            well, ill = well + good, ill + (not good)
        return well, ill


def later(now: Column, attempts: Column) -> Column:
    return now + F.make_interval(secs=F.least(attempts * DELAY_SECONDS, F.lit(MOST_DELAY_SECONDS)))
