"""Keyed mutations without a table format: upserts, tombstones, waterlines, ledgers, versions.

Each operator takes tables and a batch and returns new tables; a table is written as a
new folder (write_version) and pointed to by a small `_meta` table, so readers see whole
versions only. A batch that changes nothing gives empty deltas.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import changed_columns
from .store import Change, Store, delete
from .windows import first_by


def last_wins(batch: DataFrame, keys: Sequence[str], ordinal: Column) -> DataFrame:
    return first_by(batch, keys, ordinal.desc())


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of batch, and those of target whose key batch lacks. Columns are those of target."""
    return target.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch.select(*target.columns))


def delta(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of batch that would change target."""
    return changed_columns(batch, target, keys, [c for c in batch.columns if c not in keys])


def tombstones(previous: DataFrame, deleted: DataFrame, owners_before: DataFrame, owners_after: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys that are gone: deleted ones and those that lost their last owner, on top of the
    previous tombstones; keys that are present again are cleared."""
    released = owners_before.select(key).distinct().join(owners_after.select(key), key, "left_anti")
    gone = previous.select(key).unionByName(deleted.select(key)).unionByName(released).distinct()
    return gone.join(present.select(key), key, "left_anti")


def merge_marks(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(*(F.max(c).alias(c) for c in columns))


def clear_processed(queue: DataFrame, processed: DataFrame, key: str, version: str) -> DataFrame:
    """The queue without the entries whose version is still the one that was processed."""
    return queue.join(processed.select(key, version), [key, version], "left_anti")


def ledger_counts(ledger: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """How many keys a delta inserts, changes, leaves as they are, and removes: one pass over a full join."""
    l = ledger.select(key, F.col("content_hash").alias("old"))  # noqa: E741
    j = l.join(upserts.select(key, F.col("content_hash").alias("new")), key, "full").join(deletes.select(key, F.lit(True).alias("gone")), key, "left")
    return j.agg(
        F.count_if(F.col("old").isNull() & F.col("new").isNotNull()).alias("inserted"),
        F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))).alias("changed"),
        F.count_if(F.col("old") == F.col("new")).alias("unchanged"),
        F.count_if(F.col("old").isNotNull() & F.col("gone")).alias("removed"),
    )


def next_version(versions: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Versions with a new one for each snapshot whose content hash is not that of the latest."""
    latest = versions.groupBy(key).agg(F.max_by("content_hash", "version").alias("__hash"), F.max("version").alias("__v"))
    fresh = snapshots.join(latest, key, "left").filter(~F.col("content_hash").eqNullSafe(F.col("__hash")))
    return versions.unionByName(fresh.select(key, "content_hash", (F.coalesce("__v", F.lit(0)) + 1).cast("long").alias("version")))


def set_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys with change = `added` or `removed`."""
    return new.join(old, key, "left_anti").select(key, F.lit("added").alias("change")).unionByName(old.join(new, key, "left_anti").select(key, F.lit("removed").alias("change")))


def union_merge(existing: DataFrame, new: DataFrame, key: str, text: str, citations: str, replace: bool = False) -> DataFrame:
    """Understandings (key, text, citations): the new text where there is one, or with replace in any case,
    else the old; citations of both, each once, sorted. Keys of either side are kept."""
    n = new.select(key, F.col(text).alias("__text"), F.col(citations).alias("__citations"), F.lit(True).alias("__new"))
    j = existing.join(n, key, "full")
    blank = F.length(F.trim(F.coalesce("__text", F.lit("")))) == 0
    kept = F.col("__new").isNull() | (F.lit(False) if replace else blank)
    none = F.array().cast("array<string>")
    return j.select(key, F.when(kept, F.col(text)).otherwise(F.col("__text")).alias(text), F.array_sort(F.array_union(F.coalesce(citations, none), F.coalesce("__citations", none))).alias(citations))


def revised(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], revision: str = "revision") -> DataFrame:
    """new with the revision of each key: that of old where none of these columns changed, else one more, from 1."""
    o = old.select(key, F.col(revision).alias("__r"), *(F.col(c).alias(f"__{c}") for c in columns))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    j = new.join(o, key, "left").withColumn(revision, F.when(F.col("__r").isNull(), 1).when(same, F.col("__r")).otherwise(F.col("__r") + 1).cast("long"))
    return j.drop("__r", *(f"__{c}" for c in columns))


def message_delta(target: DataFrame, owners: DataFrame, batch: DataFrame, deleted: DataFrame, source: str) -> dict[str, DataFrame]:
    """What a delta of one source does to messages (conversation, local_id, citation, title, content).

    Messages are met by (conversation, local_id). Parts of the result: `changes` (batch rows with
    change new, changed or renamed, which is a new citation), `owners` (citation, source) after it,
    `tombstones` (citations that are gone: deleted ones that no other source owns, and old names),
    `fan_out` (messages that only take over a changed title of their conversation), `dirty`
    (citations whose chunks must be made anew, deleted ones too) and `messages`. Applied again,
    changes, tombstones of names, fan_out and dirty are empty but for what is deleted anew.
    """
    keys, columns = ["conversation", "local_id"], ["citation", "title", "content"]
    old = target.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    j = batch.join(old, keys, "left")
    renamed = F.col("__citation").isNotNull() & (F.col("__citation") != F.col("citation"))
    differs = ~F.col("title").eqNullSafe(F.col("__title")) | ~F.col("content").eqNullSafe(F.col("__content"))
    changes = j.withColumn("change", F.when(F.col("__citation").isNull(), "new").when(renamed, "renamed").when(differs, "changed")).filter("change is not null")

    mine = F.col("source") == source
    left = owners.join(deleted.select("citation"), "citation", "left_semi").filter(~mine).select("citation").distinct()
    present = target.select("citation").unionByName(batch.select("citation")).distinct()
    gone = deleted.select("citation").distinct().join(left, "citation", "left_anti").join(batch.select("citation"), "citation", "left_anti").join(present, "citation", "left_semi")
    names = changes.filter("change = 'renamed'").select(F.col("__citation").alias("citation"))
    tombstones = gone.unionByName(names).distinct()

    rest = owners.join(tombstones, "citation", "left_anti")
    rest = rest.join(deleted.select("citation", F.lit(source).alias("source")), ["citation", "source"], "left_anti")
    after = rest.unionByName(batch.select("citation", F.lit(source).alias("source"))).distinct()

    titles = batch.groupBy("conversation").agg(F.max_by("title", "local_id").alias("__new"))
    met = target.join(batch.select(*keys), keys, "left_anti").join(tombstones, "citation", "left_anti").join(titles, "conversation", "left")
    retitled = F.col("__new").isNotNull() & ~F.col("title").eqNullSafe(F.col("__new"))
    fan_out = met.filter(retitled).select(*keys, "citation", F.col("__new").alias("title"), "content")
    kept = met.withColumn("title", F.when(retitled, F.col("__new")).otherwise(F.col("title"))).select(*keys, *columns)
    dirty = changes.select("citation").unionByName(tombstones).unionByName(fan_out.select("citation")).distinct()
    return {"changes": changes.select(*keys, *columns, "change"), "owners": after, "tombstones": tombstones, "fan_out": fan_out, "dirty": dirty, "messages": kept.unionByName(batch.select(*keys, *columns))}


def rebuilt(chunks: DataFrame, fresh: DataFrame, parents: DataFrame) -> DataFrame:
    """chunks with those of some parents made anew; parents that give no chunk any more lose theirs."""
    return chunks.join(parents.select("parent").distinct(), "parent", "left_anti").unionByName(fresh.join(parents.select("parent").distinct(), "parent", "left_semi"))


def claimed(queue: DataFrame, now: Column, lease_seconds: int, limit: int) -> DataFrame:
    """Entries of a queue (entity, due, lease_until, generation) that can be claimed: due, and not leased any more;
    the earliest first, each with its new lease and generation. One entry of an entity is claimed at most."""
    free = queue.filter((F.col("due") <= now) & (F.col("lease_until").isNull() | (F.col("lease_until") <= now)))
    first = first_by(free, ["entity"], F.asc("due"), F.asc("generation"))
    top = first.orderBy("due", "entity").limit(limit)
    return top.withColumn("lease_until", now + F.make_interval(secs=F.lit(lease_seconds))).withColumn("generation", F.col("generation") + 1)


def write_version(df: DataFrame, root: str) -> int:
    """df as the next version under root, which the pointer names once it is whole."""
    spark = df.sparkSession
    version = current_version(spark, root) + 1
    df.write.mode("overwrite").parquet(f"{root}/v={version}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{root}/_meta_versions")
    return version


def current_version(spark: SparkSession, root: str) -> int:
    try:
        return spark.read.schema("version long").parquet(f"{root}/_meta_versions").agg(F.max("version")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def read_version(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v={current_version(spark, root)}")


class BucketTable:
    """One keyed table of a Store: an upsert rewrites the buckets that it changes, and no others.

    buckets is what it begins with; full ones are split. Upserts of several writers all take place.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 32, part_rows: int = 1_000_000):
        self.store, self.keys = Store(spark, root, part_rows, max(0, (buckets - 1).bit_length())), list(keys)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket and the version that wrote it."""
        t = self.store.version(version).tables.get("rows")
        return {s: p.version for s, p in t.parts.items()} if t else {}

    def version(self) -> int:
        return max(self.store.numbers(), default=0)

    def read(self) -> DataFrame | None:
        """All rows, or None before the first version."""
        return self.store.version().read("rows")

    def upsert(self, batch: DataFrame, once: tuple[str, int] | None = None) -> list[int]:
        """Puts batch (one row per key) in; the buckets that were written. A batch that changes nothing writes nothing."""
        return self.store.commit({"rows": Change(batch)}, {"rows": self.keys}, once=once).written.get("rows", [])

    def merge(self, rows_for: Callable[[DataFrame | None], DataFrame]) -> list[int]:
        """Puts in what follows from the rows that are there, and from newer ones should another writer come first."""
        return self.store.commit(lambda v: {"rows": Change(rows_for(v.read("rows")))}, {"rows": self.keys}, reads=["rows"]).written.get("rows", [])

    def vacuum(self, keep: int = 1, older_than: float = 0) -> int:
        """Deletes bucket folders that none of the newest versions names, and older entries; how many folders went."""
        return self.store.vacuum(keep, older_than)


class Generations:
    """Builds of a derived table under a root, one of which is active: building, ready, active, retired or failed.

    The ledger is a small table of events; the state of a build is its last one. What is read is the
    active build only, so one that was left half-made by a lost driver is never seen; recover()
    marks such builds as failed and deletes them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def states(self) -> dict[int, str]:
        try:
            rows = self.spark.read.schema("step long, build long, state string").parquet(f"{self.root}/ledger").orderBy("step").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        return {r["build"]: r["state"] for r in rows}

    def _note(self, *moves: tuple[int, str]) -> None:
        before = 0
        if self.states():
            before = self.spark.read.schema("step long, build long, state string").parquet(f"{self.root}/ledger").agg(F.max("step")).first()[0]
        rows = [(before + 1 + i, b, s) for i, (b, s) in enumerate(moves)]
        self.spark.createDataFrame(rows, "step long, build long, state string").coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def begin(self) -> int:
        build = max(self.states(), default=0) + 1
        self._note((build, "building"))
        return build

    def write(self, build: int, df: DataFrame) -> None:
        if self.states().get(build) != "building":
            raise ValueError(f"build {build} is not being built")
        df.write.mode("overwrite").parquet(f"{self.root}/build={build}")
        self._note((build, "ready"))

    def activate(self, build: int) -> None:
        """In one write, so that there is one active build before and after it."""
        states = self.states()
        if states.get(build) != "ready":
            raise ValueError(f"build {build} is not ready")
        self._note(*((b, "retired") for b, s in states.items() if s == "active"), (build, "active"))

    def active(self) -> int | None:
        return next((b for b, s in self.states().items() if s == "active"), None)

    def read(self) -> DataFrame | None:
        build = self.active()
        return None if build is None else self.spark.read.parquet(f"{self.root}/build={build}")

    def recover(self) -> list[int]:
        """Fails and deletes builds that were never finished; their numbers."""
        left = [b for b, s in self.states().items() if s == "building"]
        for b in left:
            delete(self.spark, f"{self.root}/build={b}")
        if left:
            self._note(*((b, "failed") for b in left))
        return left
