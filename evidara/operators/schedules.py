"""Debounce, retries, refresh queues and multi-hop promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import epoch, with_sessions


def debounced(changes: DataFrame, keys: Sequence[str], ts: str, tie: str, quiet_seconds: int) -> DataFrame:
    """One run for each burst of changes: how many it takes in, and the second at which it is due."""
    s = with_sessions(changes, keys, ts, tie, quiet_seconds)
    g = s.groupBy(*keys, "session_no").agg(F.count("*").alias("changes"), F.max(epoch(ts)).alias("__last"))
    return g.select(*keys, "session_no", "changes", (F.floor("__last") + quiet_seconds).cast("long").alias("due_second"))


def retry_state(attempts: DataFrame, keys: Sequence[str], ts: str, tie: str, failed: str, most: int = 3) -> DataFrame:
    """For each key the failures since its last success, whether it is blocked, and the next wait in seconds."""
    w = Window.partitionBy(*keys)
    last_ok = F.max(F.when(~F.col(failed), F.struct(ts, tie))).over(w)
    after = F.col(failed) & (last_ok.isNull() | (F.struct(ts, tie) > last_ok))
    g = attempts.withColumn("__after", after).groupBy(*keys).agg(F.count_if("__after").alias("failures"))
    wait = F.least(F.lit(30.0), 0.5 * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(6))))
    return g.withColumn("blocked", F.col("failures") >= most).withColumn("wait_seconds", F.when(F.col("failures") > 0, wait).otherwise(0.0))


def promoted(ranked: DataFrame, context: DataFrame, conversation: str, order: str) -> DataFrame:
    """A chain for a multi-hop answer: the top row, and the nearest context row before and after it
    in its conversation. Inputs are results, so a few hundred rows at most."""
    top = ranked.orderBy("rank").limit(1).select(conversation, F.col(order).alias("__at"))
    near = context.join(F.broadcast(top), conversation)
    side = F.when(F.col(order) < F.col("__at"), "before").when(F.col(order) > F.col("__at"), "after").otherwise("top")
    n = F.row_number().over(Window.partitionBy("side").orderBy(F.abs(F.col(order) - F.col("__at"))))
    return near.withColumn("side", side).withColumn("__n", n).filter("__n = 1").drop("__n", "__at")
