"""Readers and writers of message exports: JSONL with alias columns, archives of tables,
waterlined shards, evaluation packs, trace logs, and a small fixture."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType, TimestampType

# Names under which exports hold the same field, the first present one counts.
ALIASES = {
    "account_id": ("account_id", "account"),
    "conversation_id": ("conversation_id", "room_id", "talker", "chat_id"),
    "sender_id": ("sender_id", "sender", "from"),
    "content": ("content", "text", "message", "body"),
    "timestamp": ("timestamp", "create_time", "time", "ts"),
    "local_id": ("local_id", "id", "msg_id"),
}


def alias_column(columns: Sequence[str], names: Sequence[str], kind: str = "string") -> Column:
    """The first non-null of these columns that exist, whatever their case."""
    by_lower = {c.lower(): c for c in columns}
    have = [F.col(f"`{by_lower[n]}`").cast(kind) for n in names if n in by_lower]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def parse_timestamp(text: Column) -> Column:
    """UTC time of epoch seconds, epoch milliseconds (over 10^10) or ISO text; epoch 0 where none fits."""
    number = text.try_cast("double") if hasattr(text, "try_cast") else text.cast("double")
    seconds = F.when(F.abs(number) > 1e10, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), F.try_to_timestamp(text), F.timestamp_seconds(F.lit(0)))


def messages_from(df: DataFrame, account: str = "default") -> DataFrame:
    """Message rows of an export with any of the alias columns; rows with blank content fall away."""
    out = df.select(
        F.coalesce(alias_column(df.columns, ALIASES["account_id"]), F.lit(account)).alias("account_id"),
        *(alias_column(df.columns, ALIASES[k]).alias(k) for k in ("conversation_id", "sender_id", "content")),
        parse_timestamp(alias_column(df.columns, ALIASES["timestamp"])).alias("timestamp"),
        alias_column(df.columns, ALIASES["local_id"], "string").alias("local_id"),
    )
    out = out.filter(F.length(F.trim("content")) > 0)
    group = F.when(F.col("conversation_id").contains("@chatroom"), "group").otherwise("private")
    return out.withColumn("conversation_type", group)


def read_jsonl(spark: SparkSession, path: str, account: str = "default") -> DataFrame:
    names = sorted({n for group in ALIASES.values() for n in group})
    schema = StructType([StructField(n, StringType()) for n in names])
    return messages_from(spark.read.schema(schema).json(path), account)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in this order, as the distinct accounts and conversations of an export."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__turn", turn).filter("__turn = 1").drop("__turn")


def union_archive(tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Message rows of all tables whose name tells of messages, each with its table as shard_id."""
    chosen = {n: t for n, t in sorted(tables.items()) if "message" in n.lower() or n.lower() == "msg"}
    if not chosen:
        raise ValueError("no table of messages")
    parts = [messages_from(t.limit(limit) if limit else t).withColumn("shard_id", F.lit(n)) for n, t in chosen.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def newer_than(rows: DataFrame, marks: DataFrame, keys: list[str], local: str, time: str) -> DataFrame:
    """Rows above either high mark of their key, with late = below both, which a plain reader would lose.

    marks holds max_local and max_time by key; keys without a mark are new throughout. The
    marks, one row per key, are joined on the key and not broadcast by force.
    """
    j = rows.join(marks, keys, "left")
    fresh = F.coalesce((F.col(local) > F.col("max_local")) | (F.col(time) > F.col("max_time")), F.lit(True))
    return j.withColumn("late", ~fresh).drop("max_local", "max_time")


def waterlines(rows: DataFrame, keys: list[str], local: str, time: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(local).alias("max_local"), F.max(time).alias("max_time"))


EVAL_SCHEMA = StructType(
    [
        StructField("schema_version", LongType()),
        StructField("case_id", StringType()),
        StructField("id", StringType()),
        StructField("category", StringType()),
        StructField("query", StringType()),
        StructField("limit", LongType()),
        StructField("filters", MapType(StringType(), StringType())),
        StructField("expected_citation", StringType()),
        StructField("oracle", StructType([StructField("expected_any_citation", StringType()), StructField("min_results", LongType())])),
    ]
)


def read_eval_pack(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of either schema version: case_id, category, query, limit, expected (array)."""
    d = spark.read.schema(EVAL_SCHEMA).json(path)
    listed = F.from_json(F.col("oracle.expected_any_citation"), "array<string>")
    one = F.when(F.col("expected_citation").isNotNull(), F.array("expected_citation"))
    return d.select(
        F.coalesce("case_id", "id").alias("case_id"),
        F.coalesce("category", F.lit("default")).alias("category"),
        "query",
        F.coalesce("limit", F.lit(10)).alias("limit"),
        F.coalesce(listed, one, F.array().cast("array<string>")).alias("expected"),
    ).filter(F.col("case_id").isNotNull() & (F.length(F.trim("query")) > 0))


def newest_traces(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The newest rows of a folder of rotated JSONL traces (ts, event)."""
    schema = StructType([StructField("ts", TimestampType()), StructField("event", StringType())])
    return spark.read.schema(schema).json(path).orderBy(F.desc("ts"), "event").limit(limit)


def listing_digest(files: DataFrame) -> DataFrame:
    """One row that tells whether a set of files (path, length, modificationTime) changed, in whatever order they are listed."""
    return files.agg(F.count("*").alias("files"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("digest"))


def write_snapshot(df: DataFrame, path: str, by: str | None = None) -> None:
    """df as a new version of a table: Parquet, optionally in a folder per value of a column."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def fixture_messages(spark: SparkSession) -> DataFrame:
    """Two accounts, four conversations, twelve messages; local ids repeat across shards."""
    rows = []
    for k in range(12):
        conv = k % 4
        rows.append((f"acc{conv % 2}", f"conv{conv}", f"shard{k % 2}", k // 4, f"person{k % 3}", f"2026-06-20T09:{k:02d}:00Z", f"message {k} about plan {conv}"))
    df = spark.createDataFrame(rows, "account_id string, conversation_id string, shard_id string, local_id int, sender_id string, timestamp string, content string")
    return df.withColumn("timestamp", F.to_timestamp("timestamp"))


def tick(before: DataFrame | None, files: DataFrame, complete: bool = True) -> DataFrame:
    """One row on a watched folder since the last listing (path, length, modificationTime): changed, event_loss
    (the listing was cut short, so what is missing cannot be told from what is gone), scan_complete,
    added, altered and removed files, and the digest of what is there."""
    old = files.limit(0) if before is None else before
    o = old.select("path", F.xxhash64("length", "modificationTime").alias("__old"))
    j = files.select("path", F.xxhash64("length", "modificationTime").alias("__new")).join(o, "path", "full")
    counts = j.agg(
        F.count_if(F.col("__old").isNull()).alias("added"), F.count_if(F.col("__old") != F.col("__new")).alias("altered"), (F.count_if(F.col("__new").isNull()) if complete else F.lit(0).cast("long")).alias("removed")
    )
    out = counts.join(F.broadcast(listing_digest(files))).withColumn("changed", (F.col("added") + F.col("altered") + F.col("removed")) > 0)
    return out.select("changed", F.lit(not complete).alias("event_loss"), F.lit(complete).alias("scan_complete"), "added", "altered", "removed", "files", "digest")


def poll_seconds(idle_or_failed: int, least: float = 1.0, most: float = 300.0) -> float:
    """How long to wait after so many ticks in a row without a change or with an error."""
    return min(most, least * 2.0 ** min(idle_or_failed, 20))


class ChangeBatch:
    """Records of one account with the watermark they reach and the cursor that follows them.

    records has account_id, change_id and the row; change ids rise. A batch whose cursor was
    applied before is replayed: it is told, and gives no row.
    """

    def __init__(self, account_id: str, records: DataFrame, cursor: int, applied: int = 0):
        if not account_id or cursor < 0 or applied < 0:
            raise ValueError("a batch has an account and cursors of 0 or more")
        missing = {"account_id", "change_id"} - set(records.columns)
        if missing:
            raise ValueError(f"records lack {sorted(missing)}")
        self.account_id, self.cursor, self.applied = account_id, cursor, applied
        self.replayed = applied >= cursor
        fresh = (F.col("account_id") == account_id) & (F.col("change_id") > applied) & (F.col("change_id") <= cursor)
        self.records = records.filter(fresh)

    def problems(self, records: DataFrame) -> DataFrame:
        """Rows of another account, or beyond the cursor, that a batch must not have."""
        return records.filter((F.col("account_id") != self.account_id) | (F.col("change_id") > self.cursor))
