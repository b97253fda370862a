"""SQLite archives of messages, read in ranges of rows by the tasks.

Only names and sizes of tables go through the driver. The files must be reached under one path
by driver and executors.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import ALIASES, parse_timestamp

_COLUMNS = [*ALIASES, "shard_id"]


def message_tables(path: str) -> list[tuple[str, int, int]]:
    """(table, least and greatest row number) of the tables of an archive whose name tells of messages and that have rows."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        out = []
        for n in names:
            if "message" in n.lower() or n.lower() == "msg":
                quoted = n.replace('"', '""')
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{quoted}"').fetchone()
                if low is not None:
                    out.append((n, low, high))
    return out


def _text(value: object) -> str | None:
    from ..functions.parsing import decode_bytes

    return None if value is None else decode_bytes(value) if isinstance(value, bytes) else str(value)


def read_archive(spark: SparkSession, paths: list[str], rows_per_task: int = 100_000, limit: int | None = None) -> DataFrame:
    """Messages of all tables of messages in SQLite files, columns taken under any of their names; limit bounds the rows of each table.

    Rows with blank content fall away; other columns are left out, missing ones null.
    """
    ranges = [(p, t, a, min(a + rows_per_task - 1, high)) for p in paths for t, low, high in message_tables(p) for a in range(low, high + 1, rows_per_task)]
    if not ranges:
        raise ValueError("no table of messages with rows")
    if limit is not None:
        ranges = [(p, t, low, high) for p in paths for t, low, high in message_tables(p)]
    asked = spark.createDataFrame(ranges, "path string, tab string, low long, high long").repartition(len(ranges))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                quoted = r.tab.replace('"', '""')
                with sqlite3.connect(f"file:{r.path}?mode=ro", uri=True) as db:
                    have = {c[1].lower(): c[1] for c in db.execute(f'PRAGMA table_info("{quoted}")')}
                    names = {k: [have[n].replace('"', '""') for n in group if n in have] for k, group in ALIASES.items()}
                    fields = ", ".join(f"coalesce({', '.join(f'{chr(34)}{n}{chr(34)}' for n in ns)}, NULL)" if ns else "NULL" for ns in names.values())
                    cursor = db.execute(f'SELECT {fields} FROM "{quoted}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid LIMIT ?', (r.low, r.high, -1 if limit is None else limit))
                    while part := cursor.fetchmany(10_000):
                        yield pd.DataFrame([(*map(_text, row), r.tab) for row in part], columns=_COLUMNS, dtype=object)

    rows = asked.mapInPandas(read, ", ".join(f"{c} string" for c in _COLUMNS))
    rows = rows.filter(F.length(F.trim("content")) > 0).withColumn("timestamp", parse_timestamp(F.col("timestamp")))
    return rows.withColumn("conversation_type", F.when(F.col("conversation_id").contains("@chatroom"), "group").otherwise("private"))
