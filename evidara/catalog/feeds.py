"""Records read through the registered data sources, from files made of the given tables."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import feeds
from ..sources import tables as S
from ..sources.scratch import shared_place
from .registry import query


def available(spark, name, source, base, schema, turns):
    """All that a stream of a source gives, started anew in each turn over the same checkpoint."""
    for turn in turns:
        turn()
        rows = spark.readStream.format(name).load(source)
        rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("feed_changes", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) t WHERE n = 1 AND event_type <> 'error'""")
def feed_changes(spark, d):
    """Events as changes of their users, in batches by day, read by a stream that stops halfway: the last change of each
    user holds, and one of kind error takes the user away."""
    feeds.register(spark)
    base = shared_place(spark, "feed")
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    row = F.struct(F.lit("a").alias("account_id"), F.col("event_id").alias("change_id"), kind.alias("kind"), F.struct("user_id", "event_type").alias("row"))
    lines = S.raw(spark, d, "events").select(F.dayofmonth("ts").alias("batch"), F.to_json(row).alias("value"))
    put = lambda half: lambda: lines.filter(half).write.mode("append").partitionBy("batch").text(f"{base}/in")
    got = available(spark, "change_feed", f"{base}/in", base, feeds.ChangeFeed({}).schema(), [put(F.col("batch") < 15), put(F.col("batch") >= 15)])
    user, kind_of = F.get_json_object("row", "$.user_id").cast("long"), F.get_json_object("row", "$.event_type")
    last = got.groupBy(user.alias("user_id")).agg(F.max("change_id").alias("event_id"), F.max_by("kind", "change_id").alias("kind"), F.max_by(kind_of, "change_id").alias("event_type"))
    return last.filter("kind = 'put'").drop("kind")


@query("log_tail", "SELECT event_id, user_id, event_type FROM events")
def log_tail(spark, d):
    """Events as lines of a log of several files, read by a stream that stops after the first of them."""
    feeds.register(spark)
    base = shared_place(spark, "log")
    lines = S.raw(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    put = lambda half: lambda: lines.filter(half).select("value").write.mode("append").text(f"{base}/in")
    got = available(spark, "rotated_log", f"{base}/in", base, "file string, place long, line string", [put("event_id % 3 = 0"), put("event_id % 3 <> 0")])
    return got.select(F.from_json("line", "event_id long, user_id long, event_type string").alias("r")).select("r.*")


@query("archive_rows", "SELECT conv_id, turn, role, sha256(text) AS digest FROM conversations WHERE turn >= 2 AND role = 'user'")
def archive_rows(spark, d):
    """Messages in SQLite archives, one for each task that wrote them, read in ranges of rows by the filters of a query."""
    feeds.register(spark)
    base = shared_place(spark, "archive")

    def archived(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        place = feeds._place(base)[1]
        os.makedirs(place, exist_ok=True)
        path = f"{place}/{uuid.uuid4().hex}.db"
        with sqlite3.connect(path) as db:
            db.execute("CREATE TABLE message (conv_id INTEGER, turn INTEGER, role TEXT, text TEXT)")
            n = 0
            for f in frames:
                db.executemany("INSERT INTO message VALUES (?, ?, ?, ?)", f.itertuples(index=False, name=None))
                n += len(f)
        yield pd.DataFrame({"path": [path], "n": [n]})

    c = S.raw(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    written = [r["path"] for r in c.repartition(4).mapInPandas(archived, "path string, n long").collect()]  # a path for each task that was done
    out: DataFrame | None = None
    for path in written:
        rows = spark.read.format("sqlite_rows").schema("conv_id long, turn long, role string, text string").option("table", "message").option("rows", 500).load(path)
        out = rows if out is None else out.unionByName(rows)
    return out.filter("turn >= 2 and role = 'user'").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", F.sha2("text", 256).alias("digest"))
