"""Sources of records as Spark data sources, for batch reads and for streams with offsets.

`sqlite_rows`: a table of an SQLite archive, in ranges of row numbers; filters on its columns reach the
archive. `change_feed`: batches of changes of a provider, one folder `batch=<cursor>` each; a batch
that comes again under its cursor is not read again. `rotated_log`: lines of a log that is rotated, to the
last whole one. Offsets are row numbers, cursors, and bytes by file, so a stream that stops
goes on where its checkpoint says, and each record is read once.

Register with register(spark), then spark.read.format(name) or spark.readStream.format(name).
"""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _place(path: str):
    """The file system of a path, and the path on it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _listed(path: str, recursive: bool = False) -> list[tuple[str, str, int]]:
    """(path from here, whole path, size) of files and folders."""
    from pyarrow import fs

    files, root = _place(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=recursive))
    return sorted((f.path[len(root.rstrip("/")) + 1 :], f.path, f.size or 0) for f in found)


class Range(InputPartition):
    """Rows or bytes after start, up to end, of a place."""

    def __init__(self, place: str, start: int, end: int):
        super().__init__((place, start, end))
        self.place, self.start, self.end = place, start, end


class _Option(NamedTuple):
    path: str
    table: str
    rows: int


# SQLite ------------------------------------------------------------------------------------

#: Filters that the archive can apply to a column, as SQL; what is not here is left to Spark.
_TESTS = {EqualTo: "{} = ?", GreaterThan: "{} > ?", GreaterThanOrEqual: "{} >= ?", LessThan: "{} < ?", LessThanOrEqual: "{} <= ?"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def condition(f: Filter) -> tuple[str, list] | None:
    """A filter as a condition of the archive with its values, or None."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = _quoted(f.attribute[0])
    if type(f) in _TESTS and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
        return _TESTS[type(f)].format(column), [f.value]
    if isinstance(f, In) and f.value and all(isinstance(v, (int, float, str)) and not isinstance(v, bool) for v in f.value):
        return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, IsNotNull):
        return f"{column} IS NOT NULL", []
    if isinstance(f, IsNull):
        return f"{column} IS NULL", []
    if isinstance(f, StringStartsWith):
        return f"substr({column}, 1, length(?)) = ?", [f.value, f.value]
    if isinstance(f, StringContains):
        return f"instr({column}, ?) > 0", [f.value]
    return None


class _SqliteRead:
    def __init__(self, schema: StructType, option: _Option):
        self.columns, self.option = [f.name for f in schema.fields], option
        self.where: list[str] = []
        self.values: list = []

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{_place(self.option.path)[1]}?mode=ro", uri=True)

    def last(self) -> int:
        with self.connect() as db:
            return db.execute(f"SELECT coalesce(max(rowid), 0) FROM {_quoted(self.option.table)}").fetchone()[0]

    def ranges(self, start: int, end: int) -> list[Range]:
        step = self.option.rows
        return [Range(self.option.table, a, min(a + step, end)) for a in range(start, end, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = ", ".join(map(_quoted, self.columns))
        tests = " AND ".join(["rowid > ?", "rowid <= ?", *self.where])
        with self.connect() as db:
            yield from db.execute(f"SELECT {names} FROM {_quoted(partition.place)} WHERE {tests} ORDER BY rowid", (partition.start, partition.end, *self.values))


class _SqliteReader(_SqliteRead, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            found = condition(f)
            if found:
                self.where.append(found[0])
                self.values += found[1]
            else:
                yield f

    def partitions(self) -> Sequence[Range]:
        with self.connect() as db:
            low = db.execute(f"SELECT min(rowid) FROM {_quoted(self.option.table)}").fetchone()[0]
        return [] if low is None else self.ranges(low - 1, self.last())


class _SqliteStream(_SqliteRead, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": self.last()}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        return self.ranges(start["row"], end["row"])


class SqliteRows(DataSource):
    """Options: path, table, rows (of a task). Columns are text unless a schema is given."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def _asked(self) -> _Option:
        return _Option(self.options["path"], self.options["table"], int(self.options.get("rows", 100_000)))

    def schema(self) -> StructType:
        with _SqliteRead(StructType([]), self._asked()).connect() as db:
            names = [r[1] for r in db.execute(f"PRAGMA table_info({_quoted(self._asked().table)})")]
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, self._asked())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _SqliteStream(schema, self._asked())


# Batches of changes -------------------------------------------------------------------------


class _Changes(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def cursors(self) -> list[int]:
        return sorted(int(m[1]) for name, _, _ in _listed(self.path) if (m := re.fullmatch(r"batch=(\d+)", name)))

    def initialOffset(self) -> dict:
        return {"cursor": -1}

    def latestOffset(self) -> dict:
        return {"cursor": max(self.cursors(), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        wanted = [c for c in self.cursors() if start["cursor"] < c <= end["cursor"]]
        return [Range(path, c, size) for c in wanted for name, path, size in _listed(f"{self.path}/batch={c}") if not name.startswith(("_", "."))]

    def read(self, partition: Range) -> Iterator[tuple]:
        files, _ = _place(self.path)
        with files.open_input_stream(partition.place) as stream:
            for line in stream.read().decode().splitlines():
                r = json.loads(line)
                yield partition.start, str(r["account_id"]), int(r["change_id"]), str(r["kind"]), json.dumps(r.get("row"), sort_keys=True)


class ChangeFeed(DataSource):
    """Option: path. Lines are JSON with account_id, change_id, kind (put or delete) and row."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return "cursor long, account_id string, change_id long, kind string, row string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Changes(self.options["path"])


# Rotated logs -------------------------------------------------------------------------------

#: Bytes of a log that a task reads.
LOG_BYTES = 64 << 20


class _LogRead:
    """Files whose names rise with time, of which the last one grows. Lines belong to the range in which they begin."""

    def __init__(self, path: str):
        self.path = path

    def sizes(self) -> dict[str, int]:
        return {name: size for name, _, size in _listed(self.path) if not name.startswith(("_", "."))}

    def whole(self, name: str, size: int) -> int:
        """Where the last whole line of a file ends."""
        files, root = _place(self.path)
        with files.open_input_file(f"{root}/{name}") as f:
            end = size
            while end:
                at = max(0, end - 65_536)
                f.seek(at)
                cut = f.read(end - at).rfind(b"\n")
                if cut >= 0:
                    return at + cut + 1
                end = at
        return 0

    def ranges(self, start: dict, end: dict) -> list[Range]:
        return [Range(n, a, min(a + LOG_BYTES, size)) for n, size in sorted(end.items()) for a in range(start.get(n, 0), size, LOG_BYTES)]

    def read(self, partition: Range) -> Iterator[tuple]:
        files, root = _place(self.path)
        with files.open_input_file(f"{root}/{partition.place}") as f:
            at = max(0, partition.start - 1)  # a line that begins here comes after the end of one
            f.seek(at)
            rest, place = b"", at
            if partition.start:
                while (cut := rest.find(b"\n")) < 0:
                    more = f.read(65_536)
                    if not more:
                        return
                    rest += more
                place, rest = at + cut + 1, rest[cut + 1 :]
            while place < partition.end:
                cut = rest.find(b"\n")
                if cut < 0:
                    more = f.read(1 << 20)
                    if not more:
                        return
                    rest += more
                    continue
                yield partition.place, place, rest[:cut].decode("utf-8", "replace")
                place, rest = place + cut + 1, rest[cut + 1 :]


class _LogReader(_LogRead, DataSourceReader):
    def partitions(self) -> Sequence[Range]:
        return self.ranges({}, {n: self.whole(n, s) for n, s in self.sizes().items()})


class _LogStream(_LogRead, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {n: self.whole(n, s) for n, s in self.sizes().items()}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        return self.ranges(start, end)


class RotatedLog(DataSource):
    """Option: path, a folder of logs."""

    @classmethod
    def name(cls) -> str:
        return "rotated_log"

    def schema(self) -> StructType:
        return StructType([StructField("file", StringType()), StructField("place", LongType()), StructField("line", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LogReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _LogStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SqliteRows, ChangeFeed, RotatedLog):
        spark.dataSource.register(source)
