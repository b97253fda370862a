"""Contacts as identifier rows, and interactions on timeline items."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identifiers(contacts: DataFrame, prefix: str, key: str, kinds: Mapping[str, str]) -> DataFrame:
    """(entity_id, kind, value) of each identifier that a contact has, in one pass over the contacts."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds.items()))).alias("p")
    return contacts.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("entity_id"), pairs).select("entity_id", "p.kind", "p.value").filter("value is not null")


def with_orphans(interactions: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Interactions, all of them, with whether their item is missing."""
    have = items.select(key, F.lit(True).alias("__has")).distinct()
    return interactions.join(have, key, "left").withColumn("orphan", F.col("__has").isNull()).drop("__has")
