"""Joins with a rewrite of their own: OR conditions, token intersection, prefix keys, null-safe change detection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def either_key(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_key: str, identity: Sequence[str]) -> DataFrame:
    """Rows of left joined with right where any of left_keys equals right_key, each pair once.

    An OR condition has no hash join; one equi-join for each key and a distinct over the
    identity of a pair has.
    """
    parts = [left.join(right, left[k] == right[right_key]) for k in left_keys]
    return reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates(list(identity))


def all_tokens(df: DataFrame, key: str, tokens: Column, wanted: Sequence[str]) -> DataFrame:
    """Keys whose tokens include every wanted one."""
    w = sorted(set(wanted))
    t = df.select(F.col(key), F.explode(tokens).alias("token")).filter(F.col("token").isin(w))
    return t.groupBy(key).agg(F.countDistinct("token").alias("n")).filter(F.col("n") == len(w)).select(key)


def changed_columns(batch: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of batch that target lacks or has with another value, with change = `new` or `changed`."""
    t = target.select(*keys, *(F.col(c).alias(f"__old_{c}") for c in columns), F.lit(True).alias("__had"))
    j = batch.join(t, list(keys), "left")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__old_{c}")) for c in columns])
    out = j.withColumn("change", F.when(F.col("__had").isNull(), "new").when(differs, "changed"))
    return out.filter("change is not null").drop("__had", *(f"__old_{c}" for c in columns))


def prefix_ids(citation: Column, mark: str = "#") -> Column:
    """The part before a mark, so that a prefix join becomes an equi-join."""
    return F.substring_index(citation, mark, 1)


def flagged(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """df with whether other has its key: EXISTS as a column, without a duplicate of rows."""
    o = other.select(F.col(key), F.lit(True).alias("__has")).distinct()
    return df.join(o, key, "left").withColumn(flag, F.coalesce("__has", F.lit(False))).drop("__has")


def unique_names(files: DataFrame, stem: str, ending: str, content: str, order: str) -> DataFrame:
    """files with a name of their stem that no file of other content has: the first content of a stem keeps it, others get -1, -2 and so on."""
    first = files.groupBy(stem, content).agg(F.min(order).alias("__first"))
    n = F.row_number().over(Window.partitionBy(stem).orderBy("__first")) - 1
    numbered = first.withColumn("__n", n).drop("__first")
    name = F.concat(F.col(stem), F.when(F.col("__n") > 0, F.concat(F.lit("-"), F.col("__n").cast("string"))).otherwise(""), F.lit(ending))
    return files.join(numbered, [stem, content]).withColumn("name", name).drop("__n")
