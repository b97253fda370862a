"""Windowed operators: sessions, response times, context, episodes, samples, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first in an order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def newest_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).filter(F.col("__n") <= k).drop("__n")


def resequenced(df: DataFrame, keys: Sequence[str], *order: Column, into: str = "version") -> DataFrame:
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def epoch(c: str) -> Column:
    """Seconds of a timestamp without zone, with fractions."""
    return F.unix_micros(F.to_timestamp(F.col(c))) / 1_000_000.0


def with_sessions(df: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """df with `new_session` and `session_no` (from 1): a session starts at a gap of gap_seconds or more."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    before = F.lag(ts).over(w)
    fresh = F.when(before.isNull() | ((epoch(ts) - F.unix_micros(F.to_timestamp(before)) / 1_000_000.0) >= gap_seconds), 1).otherwise(0)
    out = df.withColumn("new_session", fresh)
    return out.withColumn("session_no", F.sum("new_session").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, written in ranges of (keys, order), with the number of its range: rows of one key may lie in several, one after another."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(parts, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def spread_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str = "n") -> DataFrame:
    """Row numbers from 1 within keys, as row_number gives, where a key may be too large for one task.

    Each range numbers its own rows; what the ranges before it hold of a key is added, from one
    row for each key of a range. order must tell the rows of a key apart.
    """
    d = _dealt(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = d.groupBy("__range", *keys).agg(F.count("*").alias("__rows"))
    carried = held.select("__range", *keys, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order))
    return d.withColumn("__own", own).join(carried, ["__range", *keys]).withColumn(into, (F.col("__own") + F.col("__before")).cast("long")).drop("__range", "__own", "__before")


def spread_sessions(df: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """As with_sessions, where a key may be too large for one task: ranges of its rows are looked at on their
    own, and what they need of the ranges before them, the last time and the number of sessions, is one row each."""
    d = _dealt(df, keys, [ts, tie])
    each = Window.partitionBy("__range", *keys).orderBy(ts, tie)
    ranges = Window.partitionBy(*keys).orderBy("__range")
    last = d.groupBy("__range", *keys).agg(F.max(ts).alias("__last"))
    last = last.select("__range", *keys, F.lag("__last").over(ranges).alias("__carried"))
    d = d.join(last, ["__range", *keys])
    before = F.coalesce(F.lag(ts).over(each), F.col("__carried"))
    fresh = F.when(before.isNull() | ((epoch(ts) - F.unix_micros(F.to_timestamp(before)) / 1_000_000.0) >= gap_seconds), 1).otherwise(0)
    d = d.withColumn("new_session", fresh).drop("__carried")
    starts = d.groupBy("__range", *keys).agg(F.sum("new_session").alias("__starts"))
    starts = starts.select("__range", *keys, F.coalesce(F.sum("__starts").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum("new_session").over(each.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__own", own).join(starts, ["__range", *keys]).withColumn("session_no", (F.col("__own") + F.col("__before")).cast("long")).drop("__range", "__own", "__before")


def response_minutes(sessions: DataFrame, keys: Sequence[str], ts: str, tie: str, direction: str) -> DataFrame:
    """Rows that answer the other side within a session, with the minutes since the row before.

    The row before is looked up among all rows, so one of unknown direction breaks the chain.
    """
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    d = sessions.withColumn("__prev_dir", F.lag(direction).over(w)).withColumn("__prev_ts", F.lag(ts).over(w))
    flips = (F.col("new_session") == 0) & F.col(direction).isin("self", "peer") & F.col("__prev_dir").isin("self", "peer") & (F.col(direction) != F.col("__prev_dir"))
    minutes = (epoch(ts) - epoch("__prev_ts")) / 60.0
    return d.filter(flips).withColumn("minutes", minutes).drop("__prev_dir", "__prev_ts")


def context_of(df: DataFrame, anchors: DataFrame, conversation: str, order: str, before: int, after: int) -> DataFrame:
    """Rows around anchors (conversation, order value), with the anchor's order and the row's offset.

    Rows are numbered once per conversation, and only where there is an anchor; each anchor names the
    numbers it wants, and joins on them.
    """
    df = df.join(anchors.select(conversation).distinct(), conversation, "left_semi")
    n = F.row_number().over(Window.partitionBy(conversation).orderBy(order)).cast("long")
    numbered = df.withColumn("__n", n)
    a = anchors.select(F.col(conversation), F.col(order).alias("anchor")).join(numbered.select(conversation, F.col(order).alias("anchor"), F.col("__n").alias("__at")), [conversation, "anchor"])
    wanted = a.withColumn("__n", F.explode(F.sequence(F.col("__at") - before, F.col("__at") + after)))
    near = numbered.join(wanted, [conversation, "__n"]).select(*numbered.columns, "anchor", "__at")
    return near.withColumn("offset", F.col("__n") - F.col("__at")).drop("__n", "__at")


def episodes(df: DataFrame, conversation: str, order: str, line: Column, stride: int = 3, radius: int = 3) -> DataFrame:
    """A window of rows around every stride-th row of a conversation: its text, size and first and last place."""
    w = Window.partitionBy(conversation).orderBy(order)
    frame = w.rowsBetween(-radius, radius)
    d = df.withColumn("__n", F.row_number().over(w)).withColumn("__line", line)
    d = d.withColumn("episode_text", F.concat_ws("\n", F.collect_list("__line").over(frame))).withColumn("members", F.count("*").over(frame))
    d = d.withColumn("first_order", F.min(order).over(frame)).withColumn("last_order", F.max(order).over(frame))
    return d.filter((F.col("__n") - 1) % stride == 0).select(conversation, F.col(order).alias("center"), "episode_text", "members", "first_order", "last_order")


def spread_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k evenly spaced rows of each group, the first and last among them; groups of k or fewer whole."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    if k == 1:
        return d.filter(F.col("__i") == F.col("__n") - 1).drop("__i", "__n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("__n") - 1) / F.lit(k - 1)).cast("long"))
    return d.filter((F.col("__n") <= k) | F.array_contains(wanted, F.col("__i").cast("long"))).drop("__i", "__n")


def capped_sessions(df: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_seconds: int, cap_seconds: int) -> DataFrame:
    """Sessions by gap, cut anew wherever they reach the next multiple of a greatest length."""
    s = with_sessions(df, keys, ts, tie, gap_seconds)
    start = F.min(ts).over(Window.partitionBy(*keys, "session_no"))
    part = F.floor((epoch(ts) - F.unix_micros(F.to_timestamp(start)) / 1_000_000.0) / cap_seconds)
    return s.withColumn("part_no", part.cast("long"))
