"""Predicates and listings over message rows; filters always come before limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_fold

RANGES = {"search": (1, 50), "list": (1, 500), "candidates": (1, 200), "context": (0, 200), "profile": (1, 50)}


def bounded_limit(kind: str, value: int) -> int:
    low, high = RANGES[kind]
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"limit of {kind} must be an integer from {low} to {high}")
    return value


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def message_filter(filters: Mapping[str, Any], sender: str = "sender", time: str = "timestamp", until_inclusive: bool = True) -> Column:
    """One condition for a mapping of filters.

    `since` and `until` bound the time column, `until` inclusively unless told otherwise;
    `sender` is contained in, or equal to, the sender without regard to case; `source_family`
    `all` means none; any other name is a column that must be equal. Empty values are ignored.
    """
    out = []
    for name, value in filters.items():
        if value is None or value == "":
            continue
        if name == "since":
            out.append(F.col(time) >= F.lit(value).cast("timestamp_ntz"))
        elif name == "until":
            bound = F.lit(value).cast("timestamp_ntz")
            out.append(F.col(time) <= bound if until_inclusive else F.col(time) < bound)
        elif name == "sender":
            out.append(contains_fold(F.col(sender), value) | (F.col(sender) == value))
        elif name in ("source_family", "scope_type"):
            if value != "all":
                out.append(F.col("source_type") == value)
        else:
            out.append(F.col(name) == F.lit(value))
    return all_of(out)


def newest_then(df: DataFrame, n: int, order: Sequence[Column], condition: Column) -> DataFrame:
    """Rows that meet a condition among the newest n; the prefilter changes results, by design."""
    return df.orderBy(*order).limit(n).filter(condition)


def newest_ascending(df: DataFrame, n: int, newest: Sequence[Column], ascending: Sequence[Column]) -> DataFrame:
    return df.orderBy(*newest).limit(n).orderBy(*ascending)


def coverage(matched: DataFrame, limit: int) -> DataFrame:
    """matched_total, returned, remaining and state of a limited listing, in one pass."""
    n = F.count("*")
    return matched.agg(n.alias("matched_total"), F.least(n, F.lit(limit)).cast("long").alias("returned"), F.greatest(n - limit, F.lit(0)).cast("long").alias("remaining"), F.when(n > limit, "partial").otherwise("complete").alias("state"))


def page_after(df: DataFrame, key: str, last: Any, size: int) -> DataFrame:
    """The next page of a keyset scan."""
    return df.filter(F.col(key) > F.lit(last)).orderBy(key).limit(size)


def within(df: DataFrame, threshold: int) -> bool:
    """Whether df has no more rows than a threshold, counting no further."""
    return df.limit(threshold + 1).count() <= threshold


def resolve_one(df: DataFrame, key: str) -> str:
    """`ok`, `ambiguous` or `no_results` for a lookup that must give one key."""
    n = len(df.select(key).distinct().limit(2).collect())
    return ("no_results", "ok", "ambiguous")[n]


def chunk_filter(filters: Mapping[str, Any], time: str = "at") -> Column:
    """message_filter for chunks: the sender is looked for in `actor`, the conversation is the `source_id`;
    conversation_type is not known of chunks and is left to residual()."""
    renamed = {("source_id" if k == "conversation_id" else k): v for k, v in filters.items() if k != "conversation_type"}
    return message_filter(renamed, sender="actor", time=time)


def residual(filters: Mapping[str, Any]) -> Column:
    """What is checked on rows of results, with regard to case: the sender contained in its name or equal to its id, and the conversation's type."""
    out = []
    if filters.get("sender"):
        out.append(F.col("actor").contains(str(filters["sender"])) | (F.col("actor_id") == filters["sender"]))
    if filters.get("conversation_type"):
        out.append(F.col("conversation_type") == filters["conversation_type"])
    return all_of(out)


def guarded_scan(df: DataFrame, narrowed: Column, needle: Column, threshold: int) -> DataFrame:
    """Rows that meet a costly condition, but only if the cheap one leaves no more than threshold rows to scan; else none. Decided in the plan."""
    left = df.filter(narrowed)
    size = left.limit(threshold + 1).agg((F.count("*") <= threshold).alias("__small"))
    return left.filter(needle).join(F.broadcast(size.filter("__small")).drop("__small"))


def resolved(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """For each of by the one key it stands for (null where several do) and a status, ok or ambiguous."""
    g = df.groupBy(*by).agg(F.min(key).alias("__low"), F.max(key).alias("__high"))
    one = F.col("__low") == F.col("__high")
    return g.select(*by, F.when(one, F.col("__low")).alias(key), F.when(one, "ok").otherwise("ambiguous").alias("status"))
