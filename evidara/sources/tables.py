"""The logical tables of the engine, as views of a folder of Parquet tables.

`messages` and `interactions` have one shape: account, conversation, sender, timestamp
or order key, content, direction, citation. No table is changed; columns are renamed or
derived, so projections and filters reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def role_direction(role: Column) -> Column:
    return F.when(role == "user", "incoming").when(role == "assistant", "outgoing").otherwise("unknown")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Chat messages without timestamps; order within a conversation is local_id."""
    c = raw(spark, folder, "conversations")
    return c.select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("local_id"),
        F.col("role").alias("sender"),
        F.col("text").alias("content"),
        role_direction(F.col("role")).alias("direction"),
        F.concat(F.lit("msg/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("citation"),
    )


def event_direction(kind: Column) -> Column:
    return F.when(kind.isin("click", "view"), "peer").when(kind.isin("purchase", "signup"), "self").otherwise("unknown")


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Timed interactions of a person; order is (ts, event_id)."""
    e = raw(spark, folder, "events")
    return e.select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), "value", "props", event_direction(F.col("event_type")).alias("direction"))


def evidence_documents(spark: SparkSession, folder: str) -> DataFrame:
    d = raw(spark, folder, "documents")
    return d.select(F.col("doc_id"), F.col("text").alias("content"), F.col("source").alias("title"), F.col("lang").alias("account"), "n_chars")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    v = raw(spark, folder, "embeddings")
    return v.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label"))


def citation_keys(citations: Sequence[str]) -> dict[str, list[tuple[int, ...]]]:
    """Whole numbers of citations `family/number/...`, by family; a part after # and malformed citations are left out."""
    out: dict[str, list[tuple[int, ...]]] = {}
    for c in dict.fromkeys(c.split("#", 1)[0] for c in citations):
        family, *numbers = c.split("/")
        if numbers and all(n.isdigit() and n.isascii() and len(n) <= 18 for n in numbers):
            out.setdefault(family, []).append(tuple(map(int, numbers)))
    return out


def evidence(spark: SparkSession, folder: str, citations: Sequence[str] | None = None) -> DataFrame:
    """Messages and documents as (citation, content, title, actor, conversation, at, source_type); those of a
    stated list are asked of the tables by their keys, so the list reaches the scans."""
    m, d = raw(spark, folder, "conversations"), raw(spark, folder, "documents")
    if citations is not None:
        keys = citation_keys(citations)
        conversations = sorted({k[0] for k in keys.get("msg", []) if len(k) == 2})
        m = m.filter(F.col("conv_id").isin(conversations) & F.col("turn").isin(sorted({k[1] for k in keys.get("msg", []) if len(k) == 2})))
        d = d.filter(F.col("doc_id").isin(sorted({k[0] for k in keys.get("doc", []) if len(k) == 1})))
    conversation = F.col("conv_id").cast("string")
    m = m.select(
        F.concat(F.lit("msg/"), conversation, F.lit("/"), F.col("turn").cast("string")).alias("citation"), F.col("text").alias("content"), F.concat(F.lit("conversation "), conversation).alias("title"),
        F.col("role").alias("actor"), conversation.alias("conversation"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.lit("message").alias("source_type"),
    )
    d = d.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("citation"), F.col("text").alias("content"), F.col("source").alias("title"), F.col("lang").alias("actor"),
        F.lit(None).cast("string").alias("conversation"), F.lit(-1).cast("long").alias("at"), F.lit("document").alias("source_type"),
    )
    out = m.unionByName(d)
    return out if citations is None else out.filter(F.col("citation").isin([c.split("#", 1)[0] for c in citations]))
