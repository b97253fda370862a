"""Reproducible shuffles: a Feistel permutation of global row numbers, cut into shards.

Rows are numbered in the order of their key. A Feistel network over the smallest even
number of bits that holds all numbers, walked along its cycles until it is back under
the row count, permutes them; position modulo the shard count is the shard, position
divided by it the slot. Where a row goes can be computed from its number alone, and
which row fills a slot from shard and slot, without any table. Shard sizes differ by
one row at most.

Defined cases: rows with a null key come first in the order; rows with equal keys are
numbered by the tie columns, and full repeats in any order, which changes no result;
an empty table gives no rows; columns of the input named as an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 6


def _round_keys(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, ROUNDS, dtype=np.uint64)


def _half_bits(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _mix(right: np.ndarray, key: np.uint64, half: int) -> np.ndarray:
    x = (right + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(64 - half)


def _network(x: np.ndarray, keys: np.ndarray, half: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ _mix(left, key, half), left
        else:
            left, right = right, left ^ _mix(right, key, half)
    return (left << np.uint64(half)) | right


def permute(numbers: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0 to n - 1 at these numbers, or with back its inverse."""
    x = np.asarray(numbers, np.uint64).copy()
    if n <= 1 or not len(x):
        return x.astype(np.int64)
    keys, half = _round_keys(seed), _half_bits(n)
    x = _network(x, keys, half, back)
    while (out := x >= n).any():  # the network's domain is less than four times n
        x[out] = _network(x[out], keys, half, back)
    return x.astype(np.int64)


def locate(number: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of the row of this number among n."""
    at = int(permute(np.array([number]), n, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The number of the row in this place."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with row_number (long, from 0 in this order, nulls first), and the row count.

    Rows are dealt by ranges and written with their range's number, so a task that runs
    again sees the same ranges; one count per range goes to the driver. Full repeats are
    parted by their place in the input, so they are no hot range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*(F.col(c).asc_nulls_first() for c in order), F.col("__place")]
    dealt = df.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(parts, *by).withColumn("__range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    counts = {r["__range"]: r["n"] for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    starts, n = [], 0
    for k in sorted(counts):
        starts.append((k, n))
        n += counts[k]
    first = df.sparkSession.createDataFrame(starts, "__range int, __first long")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1
    out = dealt.withColumn("__own", own).join(F.broadcast(first), "__range").withColumn("row_number", F.col("__first") + F.col("__own"))
    return out.drop("__place", "__range", "__own", "__first"), n


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", ties: list[str] | None = None, seed: int = 20240601) -> DataFrame:
    """df with row_number, shard and slot, under the law of rows (counts at most one apart)."""
    numbered, n = number_rows(df.drop("row_number", "shard", "slot"), [key, *(ties or [])])

    @F.pandas_udf("long")
    def position(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return numbered.withColumn("__at", position("row_number")).withColumn("shard", (F.col("__at") % shards).cast("int")).withColumn("slot", F.expr(f"__at div {shards}")).drop("__at")


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id", seed: int = 20240601) -> None:
    """df in one folder per shard, rows of a shard in the order of their slots."""
    assign_shards(df, shards, key, seed=seed).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
