"""Keyed tables under one folder, changed by commits that take place whole or not at all.

A commit is a small JSON entry `log/n` that names, for every table, its parts; it is put only if it is
absent, so of two writers one gets number n and the other finds it taken. That one looks whether the
parts it changes are still those it read: if so its entry goes on top of the newer one, else
it works the change out again. No batch is lost, whatever the number of writers. Rows lie in folders of
their own name, written before the entry: what a writer left that died between the two is named
by no entry, is never read, and goes with vacuum(). Readers hold one entry, a Version, and see all tables
as of it, whatever is committed meanwhile.

Parts are slots of the hash of a row's key. A part that grows beyond part_rows is split in two, or more,
when it is next written (extendible hashing), so a commit rewrites parts of bounded size, and only
those with rows that change. The driver holds names and counts of parts and never rows.

Entries are put by a hard link where the folder is local, else by a rename that fails if its target is
there, which must be atomic (as in HDFS).
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType, StructField, StructType

from ..sources.scratch import passing, released, settled

HASH_BITS = 31
#: Rows that a task puts in a part: larger parts are dealt to several files.
FILE_ROWS = 100_000
#: After more rows than these are written, files of their shuffles are deleted at once.
RELEASED_ROWS = 100_000
#: Longer texts are compared by their SHA-256 with those that are held.
LONG = 64


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def text_of(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """A file with this text, unless there is one of that name; whoever sees it sees all of it."""
    jvm = spark._jvm
    target, fs = _fs(spark, path)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            at = lambda p: jvm.java.nio.file.Paths.get(jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(at(target), at(draft))
        else:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(draft, False)


def brief(f: StructField) -> Column:
    """A column by which equal values are told as by the value itself, but which stays short."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, NumericType):
        return F.unhex(F.sha2(c.cast("string"), 256)).alias(f.name)
    if isinstance(f.dataType, StringType):
        return F.when(F.length(c) > LONG, F.concat(F.lit("\0"), F.sha2(c, 256))).otherwise(c).alias(f.name)
    return c.alias(f.name)


class Part(NamedTuple):
    folder: str
    rows: int
    version: int


class Table(NamedTuple):
    """place names the column that is the number of a row's part, one of the keys, or after a # the key
    columns whose hash tells the part; without it, the hash of all keys does."""

    keys: list[str]
    schema: str
    parts: dict[int, Part]
    place: str = ""

    @property
    def hashed(self) -> list[str]:
        return self.place[1:].split(",") if self.place.startswith("#") else self.keys

    @property
    def numbered(self) -> bool:
        return bool(self.place) and not self.place.startswith("#")


class Change(NamedTuple):
    """What a commit does to a table: rows put in (one for each key), keys (in any columns more) taken out.

    sizes says of upserts that are made of parts whose hash is theirs too: the hashed columns and n, the number
    of rows. A new table is then written as they lie, without a shuffle. differs says that upserts are known to be
    new or changed, so that they are not compared with what is held."""

    upserts: DataFrame | None = None
    deletes: DataFrame | None = None
    sizes: DataFrame | None = None
    differs: bool = False


class Commit(NamedTuple):
    """The version that holds the change, rows by table and kind (inserted, changed, unchanged, deleted), and the parts written.

    written is empty where nothing changed; then the version is the one that was there."""

    version: int
    counts: dict[str, dict[str, int]]
    written: dict[str, list[int]]


class Staged(NamedTuple):
    table: Table
    replaced: dict[int, Part]
    parts: dict[int, Part]
    counts: dict[str, int]


class Version:
    """All tables as of one commit."""

    def __init__(self, store: Store, number: int, tables: dict[str, Table], marks: dict[str, int], attached: dict[str, object]):
        self.store, self.number, self.tables, self.marks, self.attached = store, number, tables, marks, attached

    def read(self, table: str) -> DataFrame | None:
        """All rows, or None if there is no such table."""
        t = self.tables.get(table)
        return self.store._rows(table, t, sorted(t.parts)) if t else None

    def lookup(self, table: str, keys: DataFrame) -> DataFrame | None:
        """Rows whose hashed columns are among keys: reads the parts that these lie in, and no others."""
        t = self.tables.get(table)
        if t is None or not t.parts:
            return self.read(table)
        keys = keys.select(*t.hashed).distinct()
        return self.near(table, keys).join(keys, t.hashed, "left_semi")

    def near(self, table: str, keys: DataFrame) -> DataFrame | None:
        """All rows of the parts that keys lie in."""
        t = self.tables.get(table)
        if t is None or not t.parts:
            return self.read(table)
        slots = [r[0] for r in self.store._routed(keys.select(*t.hashed), t, sorted(t.parts)).select("__slot").distinct().collect()]
        return self.part(table, slots)

    def part(self, table: str, slots: Sequence[int]) -> DataFrame:
        t = self.tables[table]
        return self.store._rows(table, t, [s for s in slots if s in t.parts])


class Store:
    """split says how many parts a new table begins with: 2 ** split."""

    def __init__(self, spark: SparkSession, root: str, part_rows: int = 1_000_000, split: int = 0):
        self.spark, self.root, self.part_rows, self.split = spark, root.rstrip("/"), part_rows, split

    # versions

    def numbers(self) -> list[int]:
        return sorted(int(x) for x in names_in(self.spark, f"{self.root}/log") if x.isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of a number; version 0 has no tables."""
        n = max(self.numbers(), default=0) if number is None else number
        if not n:
            return Version(self, 0, {}, {}, {})
        e = json.loads(text_of(self.spark, f"{self.root}/log/{n:012d}"))
        tables = {t: Table(v["keys"], v["schema"], {int(s): Part(*p) for s, p in v["parts"].items()}, v["place"]) for t, v in e["tables"].items()}
        return Version(self, n, tables, e["marks"], e["attached"])

    def _put(self, v: Version) -> bool:
        tables = {t: {"keys": x.keys, "schema": x.schema, "place": x.place, "parts": {str(s): list(p) for s, p in x.parts.items()}} for t, x in v.tables.items()}
        return put_if_absent(self.spark, f"{self.root}/log/{v.number:012d}", json.dumps({"tables": tables, "marks": v.marks, "attached": v.attached}))

    # rows

    def _schema(self, t: Table) -> StructType:
        return StructType.fromJson(json.loads(t.schema))

    def _rows(self, name: str, t: Table, slots: Sequence[int]) -> DataFrame:
        paths = [f"{self.root}/data/{name}/{t.parts[s].folder}/slot={s}" for s in slots]
        return self.spark.read.schema(self._schema(t)).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema(t))

    def _routed(self, df: DataFrame, t: Table, slots: Sequence[int]) -> DataFrame:
        """df with __hash and __slot, the slot of each row among those of a table."""
        if t.numbered:
            return df.withColumn("__hash", F.lit(0).cast("long")).withColumn("__slot", F.col(t.place).cast("long"))
        keys = t.hashed
        low = F.xxhash64(*keys).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
        df = df.withColumn("__hash", low)
        depth = max(s.bit_length() - 1 for s in slots)
        if depth == 0:
            return df.withColumn("__slot", F.lit(1).cast("long"))
        if all(s.bit_length() - 1 == depth for s in slots):
            return df.withColumn("__slot", F.col("__hash").bitwiseAND(F.lit((1 << depth) - 1)) + (1 << depth))
        # Slots of several depths: a slot stands for all endings of depth bits that it is the end of.
        ends = [((end << (s.bit_length() - 1)) | (s ^ 1 << s.bit_length() - 1), s) for s in slots for end in range(1 << depth - s.bit_length() + 1)]
        directory = self.spark.createDataFrame(ends, "__end long, __slot long")
        return df.withColumn("__end", F.col("__hash").bitwiseAND(F.lit((1 << depth) - 1))).join(F.broadcast(directory), "__end").drop("__end")

    def stage(self, base: Version, name: str, change: Change, keys: Sequence[str], place: str = "") -> tuple[Staged, DataFrame]:
        """For the plan of a commit: the written parts of a change, which stand for it there, and their rows."""
        s = self._stage(base, name, change, keys, place)
        return s, self._rows(name, s.table._replace(parts=s.parts), sorted(s.parts))

    def _stage(self, base: Version, name: str, change: Change, keys: Sequence[str], place: str) -> Staged:
        """The parts that a change makes, written, and the parts that they take the place of; nothing else is left."""
        with passing(self.spark):
            s = self._written(base, name, change, keys, place)
        if sum(p.rows for p in s.parts.values()) > RELEASED_ROWS:
            released(self.spark)
        return s

    def _written(self, base: Version, name: str, change: Change, keys: Sequence[str], place: str) -> Staged:
        t = base.tables.get(name)
        if t is None:
            if change.upserts is None:
                return Staged(Table(list(keys), "", {}, place), {}, {}, {})
            t = Table(list(keys), change.upserts.schema.json(), {}, place)
        columns = [f.name for f in self._schema(t).fields]
        if change.upserts is not None and sorted(change.upserts.columns) != sorted(columns):
            raise ValueError(f"columns of {name} are {columns}, not {change.upserts.columns}")
        slots = sorted(t.parts) or [(1 << self.split) + i for i in range(1 << self.split)]
        counts: dict[str, int] = {}
        growth: dict[int, int] = {}
        touched: list[int] = []
        written = None
        if not t.parts:  # all that comes is new
            if change.upserts is not None:
                sizes, n = (change.upserts, F.count("*")) if change.sizes is None else (change.sizes, F.sum("n"))
                growth = {r[0]: r[1] for r in self._routed(sizes, t, slots).groupBy("__slot").agg(n).collect()}  # numbers of parts
            if growth:
                counts["inserted"] = sum(growth.values())
        else:
            written = self._met(name, t, slots, columns, change, counts, growth)
            touched = [s for s in growth if s in t.parts]
        if not growth:
            return Staged(t, {}, {}, counts)
        folder = uuid.uuid4().hex
        place = f"{self.root}/data/{name}/{folder}"
        spread = []
        for slot, more in growth.items():
            size = more + (t.parts[slot].rows if slot in t.parts else 0)
            depth = slot.bit_length() - 1
            into = depth if t.numbered else min(HASH_BITS, depth + max(0, math.ceil(math.log2(max(size, 1) / self.part_rows))))
            spread.append((slot, into, max(1, math.ceil(size / 2 ** max(0, into - depth) / FILE_ROWS))))
        if written is None:
            rows = self._spread(self._routed(change.upserts, t, slots), t, spread).select("slot", "__deal", *columns)
            rows = rows.drop("__deal") if change.sizes is not None else rows.repartition("slot", "__deal").drop("__deal")
        else:
            # Rows that are held and rows that come meet in one shuffle; of those of a key the one that comes is the first.
            held = self._routed(self._rows(name, t, touched), t, slots).select("__slot", "__hash", *columns, F.lit(True).alias("__held"), F.lit(False).alias("__gone"))
            come = written.select("__slot", "__hash", *(F.col(c) if c in t.keys else F.col("__new")[c].alias(c) for c in columns), F.lit(False).alias("__held"), "__gone")
            both = self._spread(held.unionByName(come), t, spread).repartition("slot", "__deal")
            before = F.lag(F.lit(True)).over(Window.partitionBy("slot", "__deal", *t.keys).orderBy("__held", "__gone"))
            rows = both.withColumn("__later", before).filter("__later is null and not __gone").select("slot", *columns)
        rows.write.option("compression", "zstd").partitionBy("slot").parquet(place)
        found = {r[0]: r[1] for r in self.spark.read.parquet(place).groupBy("slot").count().collect()} if any(n.startswith("slot=") for n in names_in(self.spark, place)) else {}
        parts = {int(s): Part(folder, n, 0) for s, n in found.items()}
        return Staged(t, {s: t.parts[s] for s in touched}, parts, counts)

    def _spread(self, rows: DataFrame, t: Table, spread: Sequence[tuple[int, int, int]]) -> DataFrame:
        """Routed rows with slot, after parts that have grown are split, and __deal, the file of the part."""
        if all(into == slot.bit_length() - 1 and files == 1 for slot, into, files in spread):
            return rows.withColumn("slot", F.col("__slot")).withColumn("__deal", F.lit(0).cast("long"))
        named = self.spark.createDataFrame(list(spread), "__slot long, __depth int, __files int")
        rows = rows.join(F.broadcast(named), "__slot")
        below = F.expr("shiftleft(1L, __depth)")
        slot = F.col("__slot") if t.numbered else F.when(below <= F.col("__slot"), F.col("__slot")).otherwise(F.col("__hash").bitwiseAND(below - 1) + below)
        return rows.withColumn("slot", slot).withColumn("__deal", F.pmod(F.xxhash64(F.lit(1), *t.keys), F.col("__files")))

    def _met(self, name: str, t: Table, slots: Sequence[int], columns: Sequence[str], change: Change, counts: dict[str, int], growth: dict[int, int]) -> DataFrame:
        """The rows of a change that differ from what is held; fills counts by kind and growth by slot."""
        schema = self._schema(t)
        short = F.struct(*map(brief, schema.fields)) if not change.differs else F.struct(F.lit(True).alias("__there"))
        named = None
        for df, gone in ((change.upserts, False), (change.deletes, True)):
            if df is not None:
                row = F.struct(*(F.col(c) for c in columns)) if not gone else F.lit(None).cast(schema)
                part = self._routed(df, t, slots).select("__slot", "__hash", *t.keys, row.alias("__new"), (short if not gone and not change.differs else F.lit(None)).alias("__short"), F.lit(gone).alias("__gone"))
                named = part if named is None else named.unionByName(part)
        asked = [r[0] for r in named.select("__slot").distinct().collect()]  # numbers of parts
        held = self._rows(name, t, [s for s in asked if s in t.parts])
        old = held.select(*t.keys, short.alias("__old"))
        status = F.when(F.col("__gone"), F.when(F.col("__old").isNotNull(), "deleted")).when(F.col("__old").isNull(), "inserted")
        status = status.when(F.col("__old").eqNullSafe(F.col("__short")), "unchanged").otherwise("changed")
        met = settled(named.join(old, t.keys, "left").withColumn("__status", status).filter("__status is not null").drop("__old", "__short"), "change")
        for slot, kind, n in met.groupBy("__slot", "__status").count().collect():
            counts[kind] = counts.get(kind, 0) + n
            if kind != "unchanged":
                growth[slot] = growth.get(slot, 0) + {"inserted": n, "deleted": -n}.get(kind, 0)
        return met.filter("__status <> 'unchanged'")

    # commits

    def commit(
        self, plan: Mapping[str, Change] | Callable[[Version], Mapping[str, Change]], keys: Mapping[str, Sequence[str]] | None = None,
        places: Mapping[str, str] | None = None, reads: Sequence[str] = (), once: tuple[str, int] | None = None,
        attach: Callable[[Version], Mapping[str, object]] | None = None, attempts: int = 50,
    ) -> Commit:
        """Changes tables together. A plan that depends on what is there is a function of the version, and may
        stage() a table itself, to make others of the rows as they were written.

        keys and places: the key columns, and the column that is the part, of tables that are new. reads: tables that the plan depends on as a whole,
        so that any change of them makes it run again. once: a name and a number that rises; a
        commit whose number is not above the last one of its name is a replay and does nothing.
        attach: after the plan, values to be held by name beside the tables (None takes one away);
        another commit that attaches makes it run again. What is settled meanwhile goes with the commit's end.
        """
        with passing(self.spark):
            return self._commit(plan, keys or {}, places or {}, reads, once, attach, attempts)

    def _commit(self, plan, keys, places, reads, once, attach, attempts) -> Commit:
        base, made, values = self.version(), {}, {}
        for _ in range(attempts):
            if once and base.marks.get(once[0], -1) >= once[1]:
                return Commit(base.number, {}, {})
            if not made and not values:
                changes = plan(base) if callable(plan) else plan
                made = {n: c if isinstance(c, Staged) else self._stage(base, n, c, keys.get(n, ()), places.get(n, "")) for n, c in changes.items() if isinstance(c, Staged) or c.upserts is not None or c.deletes is not None}
                values = dict(attach(base)) if attach else {}
                before = base.attached
                seen = {n: base.tables[n].parts if n in base.tables else None for n in reads}
            counts = {n: s.counts for n, s in made.items()}
            writes = {n: s for n, s in made.items() if s.parts or s.replaced}
            if not writes and not values and not once:
                return Commit(base.number, counts, {})
            n = base.number + 1
            tables = dict(base.tables)
            for name, s in writes.items():
                parts = {k: p for k, p in (tables[name].parts if name in tables else {}).items() if k not in s.replaced}
                tables[name] = s.table._replace(parts={**parts, **{k: p._replace(version=n) for k, p in s.parts.items()}})
            attached = {k: v for k, v in {**base.attached, **values}.items() if v is not None}
            if self._put(Version(self, n, tables, {**base.marks, **({once[0]: once[1]} if once else {})}, attached)):
                return Commit(n, counts, {name: sorted(s.parts) for name, s in writes.items()})
            base = self.version()
            if not self._holds(base, made, seen) or values and base.attached != before:
                for name, s in made.items():
                    for folder in {p.folder for p in s.parts.values()}:
                        delete(self.spark, f"{self.root}/data/{name}/{folder}")
                made, values = {}, {}
        raise RuntimeError(f"{attempts} other commits came first")

    def _holds(self, newer: Version, made: Mapping[str, Staged], seen: Mapping[str, dict | None]) -> bool:
        """Whether staged parts still follow from a newer version: nothing changed in their slots, or in what was read."""
        for name, parts in seen.items():
            now = newer.tables[name].parts if name in newer.tables else None
            if parts != now:
                return False
        for name, s in made.items():
            now = newer.tables[name].parts if name in newer.tables else {}
            if bool(now) != bool(s.table.parts):
                return False
            if s.table.parts and s.parts.keys() | s.replaced.keys():
                changed = {k for k in now.keys() | s.table.parts.keys() if now.get(k) != s.table.parts.get(k)}
                mine = s.parts.keys() | s.replaced.keys()
                if changed & mine if s.table.numbered else any(_overlaps(a, b) for a in changed for b in mine):
                    return False
        return True

    def vacuum(self, keep: int = 1, older_than: float = 0) -> int:
        """Deletes folders of parts that none of the newest versions names, if they are so many seconds old, and
        older entries; how many folders went. Writers at work need a time longer than a commit takes."""
        numbers = self.numbers()
        held = [self.version(n) for n in numbers[-keep:]]
        named = {(t, p.folder, s) for v in held for t, x in v.tables.items() for s, p in x.parts.items()}
        gone = 0
        for table in names_in(self.spark, f"{self.root}/data"):
            for folder in names_in(self.spark, f"{self.root}/data/{table}"):
                p, fs = _fs(self.spark, f"{self.root}/data/{table}/{folder}")
                if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 < older_than:
                    continue
                inside = [x for x in names_in(self.spark, f"{self.root}/data/{table}/{folder}") if x.startswith("slot=")]
                dead = [x for x in inside if (table, folder, int(x[5:])) not in named]
                gone += len(dead)
                for x in dead:
                    delete(self.spark, f"{self.root}/data/{table}/{folder}/{x}")
                if len(dead) == len(inside):
                    delete(self.spark, f"{self.root}/data/{table}/{folder}")
        for n in numbers[:-keep]:
            delete(self.spark, f"{self.root}/log/{n:012d}")
        return gone


def _overlaps(a: int, b: int) -> bool:
    """Whether a hash can end in both slots: one is the end of the other."""
    bits = min(a.bit_length(), b.bit_length()) - 1
    return (a ^ b) & ((1 << bits) - 1) == 0


class Generation:
    """A counter that tells whether a publication of several commits is whole: even when it is, odd while one is at work.

    Numbers are put if absent, so one of several writers gets a claim. recover() closes the claim of a
    writer that is gone; should that one come back, its complete() fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self) -> int:
        return max((int(x) for x in names_in(self.spark, self.root) if x.isdigit()), default=0)

    def _put(self, n: int) -> bool:
        return put_if_absent(self.spark, f"{self.root}/{n:012d}", str(n))

    def claim(self, expected: int) -> int | None:
        """The odd number after expected, if expected is even and still the last one."""
        if expected % 2 or self.read() != expected or not self._put(expected + 1):
            return None
        return expected + 1

    def complete(self, claimed: int) -> int:
        if not claimed % 2:
            raise ValueError("a claim is an odd number")
        if self.read() != claimed or not self._put(claimed + 1):
            raise RuntimeError("the claim was lost")
        return claimed + 1

    def recover(self) -> int:
        """The even number that holds now; a claim that was open is closed."""
        n = self.read()
        if n % 2:
            self._put(n + 1)
            return n + 1
        return n
