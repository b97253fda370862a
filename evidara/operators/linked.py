"""Upserts of linked tables in one commit, and purges that walk their links.

Media: assets, the links that place them, the source rows that name them, and the jobs that follow.
An asset that is known by its content keeps the id that it has, and its links follow it there; what
would change nothing is no change, so a replay writes nothing. People: entities, observations, and the
identifiers that come of both. Everything a batch leads to is in the commit that holds the batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .store import Change, Commit, Store, Version
from .windows import first_by

ASSET = "asset_id string, account string, source_type string, source_id string, modality string, media_type string, content_hash string, path_ref string, cache_state string, processing_state string"
LINK = "link_id string, asset_id string, scope_type string, accepted boolean, reason string, source_citation string"
SOURCE_ROW = "source_key string, row_id long, fingerprint string, asset_id string"
JOB = "asset_id string, job_type string, status string, error_code string"
MEDIA = {"assets": ["asset_id"], "links": ["link_id"], "source_rows": ["source_key", "row_id"], "jobs": ["asset_id", "job_type"]}
CONTENT = ["account", "source_type", "source_id", "modality", "media_type", "content_hash"]
# How much is known of an asset's bytes in each state.
CACHE_RANK = {"unknown": 0, "inventory_only": 0, "metadata_only": 1, "missing_local_cache": 2, "source_available": 3, "cached": 3, "copied": 4, "normalized": 5}


def _rank(state: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CACHE_RANK.items() for x in kv))[state], F.lit(0))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class MediaGraph:
    """Tables assets, links, source_rows and jobs of a Store."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def _held(self, v: Version, table: str, schema: str) -> DataFrame:
        rows = v.read(table)
        return self.spark.createDataFrame([], schema) if rows is None else rows

    def upsert(self, assets: DataFrame, links: DataFrame, source_rows: DataFrame | None = None, dropped: DataFrame | None = None) -> Commit:
        """assets (ASSET, and placeholder: known by metadata only), links (LINK), source_rows and dropped ones (source_key, row_id).

        Of rows with one id the last holds, by the column ordinal of assets and links. A placeholder does not take
        back what is known of an asset. A row of known content takes the id that has it, unless
        it is held already just as it is given, so a replay writes nothing. Assets whose last source row is dropped are stale, their links
        not accepted. A voice asset in an accepted private link has a job; others have theirs skipped.
        """

        def plan(v: Version) -> dict[str, Change]:
            old = self._held(v, "assets", ASSET)
            of_content = old.filter("content_hash is not null").groupBy(*CONTENT).agg(F.min("asset_id").alias("known_id"))
            row = F.struct(*_names(ASSET))
            batch = first_by(assets, ["asset_id"], F.desc("ordinal")).join(of_content, CONTENT, "left").join(old.select("asset_id", row.alias("held_row")), "asset_id", "left")
            known = F.when(~row.eqNullSafe(F.col("held_row")), F.col("known_id"))
            batch = settled(batch.withColumn("known_id", known).drop("held_row").withColumn("given_id", F.col("asset_id")).withColumn("asset_id", F.coalesce("known_id", "asset_id")), "assets")
            ids = batch.select(F.col("given_id").alias("asset_id"), F.col("asset_id").alias("kept_id"))
            before = old.select("asset_id", *(F.col(c).alias(f"old_{c}") for c in ("path_ref", "content_hash", "cache_state", "processing_state")))
            merged = first_by(batch, ["asset_id"], F.desc("ordinal")).join(before, "asset_id", "left")
            held = F.col("placeholder") & F.col("old_cache_state").isNotNull()
            keep = lambda c: F.when(held, F.coalesce(F.col(c), F.col(f"old_{c}"))).otherwise(F.col(c)).alias(c)
            at_work = ~F.col("old_processing_state").isin("pending", "metadata_only")
            new = merged.select(
                "asset_id", *CONTENT[:-1], keep("content_hash"), keep("path_ref"),
                F.when(held & (_rank(F.col("old_cache_state")) > _rank(F.col("cache_state"))), F.col("old_cache_state")).otherwise(F.col("cache_state")).alias("cache_state"),
                F.when(held & at_work, F.col("old_processing_state")).otherwise(F.col("processing_state")).alias("processing_state"),
            )
            put = first_by(links, ["link_id"], F.desc("ordinal")).join(ids, "asset_id", "left")
            put = put.withColumn("asset_id", F.coalesce("kept_id", "asset_id")).select(*_names(LINK))
            all_links = self._held(v, "links", LINK).join(put.select("link_id"), "link_id", "left_anti").unionByName(put)

            changes = {}
            rows = self._held(v, "source_rows", SOURCE_ROW)
            gone_ids = self.spark.createDataFrame([], "asset_id string")
            if dropped is not None:
                gone = settled(rows.join(dropped.select("source_key", "row_id").distinct(), ["source_key", "row_id"]), "dropped")
                left = rows.join(gone.select("source_key", "row_id"), ["source_key", "row_id"], "left_anti")
                left = left if source_rows is None else left.unionByName(source_rows.select(*_names(SOURCE_ROW)))
                gone_ids = gone.select("asset_id").distinct().join(left.select("asset_id"), "asset_id", "left_anti")
                changes["source_rows"] = Change(None, gone.select("source_key", "row_id"))
            if source_rows is not None:
                changes["source_rows"] = Change(source_rows.join(ids, "asset_id", "left").withColumn("asset_id", F.coalesce("kept_id", "asset_id")).select(*_names(SOURCE_ROW)), changes.get("source_rows", Change()).deletes)
            gone_ids = settled(gone_ids, "stale")
            new = settled(new.unionByName(old.join(gone_ids, "asset_id", "left_semi").join(new.select("asset_id"), "asset_id", "left_anti").withColumn("processing_state", F.lit("stale"))), "assets")
            stale = all_links.join(gone_ids, "asset_id", "left_semi").withColumns({"accepted": F.lit(False), "reason": F.lit("source_deleted")})
            put = put.join(stale.select("link_id"), "link_id", "left_anti").unionByName(stale)

            # Jobs of the assets that this batch changes, or whose links it does.
            moved = settled(new.join(old, _names(ASSET), "left_anti").select("asset_id").unionByName(put.join(self._held(v, "links", LINK), _names(LINK), "left_anti").select("asset_id")).distinct(), "moved")
            now = old.join(moved, "asset_id", "left_semi").join(new.select("asset_id"), "asset_id", "left_anti").unionByName(new.join(moved, "asset_id", "left_semi"))
            scoped = all_links.join(stale.select("link_id"), "link_id", "left_anti").filter("accepted and scope_type = 'private_chat'").select("asset_id").distinct()
            able = now.filter("modality = 'voice' and processing_state <> 'stale'").join(scoped, "asset_id", "left_semi").select("asset_id", F.lit(True).alias("able"))
            job = moved.join(able, "asset_id", "left").join(self._held(v, "jobs", JOB), "asset_id", "left")
            reopened = F.col("able") & (F.col("status").isNull() | ((F.col("status") == "skipped") & (F.col("error_code") == "out_of_scope")))
            skipped = F.col("able").isNull() & F.col("status").isNotNull()
            jobs = job.filter(reopened | skipped).select(
                "asset_id", F.lit("voice_transcribe").alias("job_type"), F.when(F.col("able"), "pending").otherwise("skipped").alias("status"), F.when(F.col("able"), None).otherwise(F.lit("out_of_scope")).alias("error_code"),
            )
            return {**changes, "assets": Change(new.select(*_names(ASSET))), "links": Change(put), "jobs": Change(jobs)}

        return self.store.commit(plan, keys=MEDIA, reads=list(MEDIA))


ENTITY = "entity_id string, entity_type string, display_name string, status string, confidence double"
OBSERVATION = "observation_id string, entity_id string, observation_type string, value string, status string, confidence double, citation string"
IDENTIFIER = "entity_id string, identifier_type string, normalized_value string, source string, confidence double, citation string"
PEOPLE = {"entities": ["entity_id"], "observations": ["observation_id"], "identifiers": ["entity_id", "identifier_type", "normalized_value", "source"]}
#: Statuses of observations whose values identify, and all statuses there are.
IDENTIFYING, STATUSES = ("active", "needs_review", "merge_candidate"), ("active", "needs_review", "merge_candidate", "superseded", "rejected", "retired")


class People:
    """Tables entities, observations and identifiers of a Store."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def upsert(self, entities: DataFrame, observations: DataFrame, identifying: Sequence[str] = ("alias", "user_id", "remark")) -> tuple[Commit, int]:
        """One batch, and how many observations it leaves out: without citation, of a status that is none, or of nobody,
        neither of the batch nor kept. Identifiers of the entities of the batch are made anew from all their observations."""
        left_out = [0]

        def plan(v: Version) -> dict[str, Change]:
            held = {n: (v.read(n) if n in v.tables else self.spark.createDataFrame([], s)) for n, s in (("entities", ENTITY), ("observations", OBSERVATION), ("identifiers", IDENTIFIER))}
            known = entities.select("entity_id").unionByName(held["entities"].select("entity_id")).distinct()
            sound = observations.filter((F.col("citation") != "") & F.col("status").isin(*STATUSES)).join(known, "entity_id", "left_semi")
            sound = settled(sound.select(*_names(OBSERVATION)), "observations")
            left_out[0] = observations.count() - sound.count()
            touched = settled(entities.select("entity_id").unionByName(sound.select("entity_id")).distinct(), "touched")
            now = lambda name, key, new: held[name].join(new.select(key), key, "left_anti").unionByName(new).join(touched, "entity_id", "left_semi")
            normal = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
            bounded = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
            of_names = now("entities", "entity_id", entities.select(*_names(ENTITY))).select("entity_id", F.lit("display_name").alias("identifier_type"), normal("display_name").alias("normalized_value"), F.lit("entity").alias("source"), bounded.alias("confidence"), F.lit(None).cast("string").alias("citation"))
            seen = now("observations", "observation_id", sound).filter(F.col("status").isin(*IDENTIFYING) & F.lower("observation_type").isin(*identifying))
            of_seen = seen.select("entity_id", F.lower("observation_type").alias("identifier_type"), normal("value").alias("normalized_value"), F.lit("observation").alias("source"), bounded.alias("confidence"), "citation")
            of_seen = of_seen.groupBy(*PEOPLE["identifiers"]).agg(F.max("confidence").alias("confidence"), F.max("citation").alias("citation"))
            fresh = settled(of_names.unionByName(of_seen).filter("normalized_value <> ''"), "identifiers")
            gone = held["identifiers"].join(touched, "entity_id", "left_semi").join(fresh.select(*PEOPLE["identifiers"]), PEOPLE["identifiers"], "left_anti")
            return {"entities": Change(entities.select(*_names(ENTITY))), "observations": Change(sound), "identifiers": Change(fresh, gone)}

        return self.store.commit(plan, keys=PEOPLE, reads=list(PEOPLE)), left_out[0]


class Link(NamedTuple):
    """Rows of table whose column names a key of parent go when that key goes."""

    table: str
    column: str
    parent: str


AUDIT = "purge string, step int, table string, removed long"


def purge(store: Store, name: str, table: str, keys: DataFrame, links: Sequence[Link]) -> Commit:
    """Deletes the rows of table with these keys and all that depends on them, level by level, in one commit.

    links are in an order in which a parent comes before what names it; a parent has one key
    column. A row for each table is added to the table audit, under the name of the purge: a second
    purge of that name is a replay and does nothing.
    """

    def plan(v: Version) -> dict[str, Change]:
        gone: dict[str, DataFrame] = {table: settled(v.read(table).join(keys.distinct(), v.tables[table].keys, "left_semi").select(*v.tables[table].keys), "gone")}
        for link in links:
            if link.parent not in gone or link.table not in v.tables:
                continue
            parent = gone[link.parent].select(F.col(v.tables[link.parent].keys[0]).alias(link.column))
            found = v.read(link.table).join(parent, link.column, "left_semi").select(*v.tables[link.table].keys)
            before = gone.get(link.table)
            gone[link.table] = settled(found if before is None else before.unionByName(found).distinct(), "gone")
        store_rows = [(name, i, t, df.count()) for i, (t, df) in enumerate(gone.items())]
        done = v.read("audit")
        if done is not None and done.filter(F.col("purge") == name).limit(1).count():
            return {}
        return {**{t: Change(None, df) for t, df in gone.items()}, "audit": Change(store.spark.createDataFrame(store_rows, AUDIT))}

    return store.commit(plan, keys={"audit": ["purge", "step"]}, reads=[table, *(x.table for x in links)])


def dangling(version: Version, links: Sequence[Link]) -> DataFrame:
    """table, parent and n of rows that name a key which is not there: nothing, after a purge of whole tables."""
    out = None
    for link in links:
        parent = version.read(link.parent).select(F.col(version.tables[link.parent].keys[0]).alias(link.column))
        n = version.read(link.table).filter(F.col(link.column).isNotNull()).join(parent, link.column, "left_anti").agg(F.count("*").alias("n"))
        row = n.select(F.lit(link.table).alias("table"), F.lit(link.parent).alias("parent"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def counts_of(spark, commit: Commit, tables: Mapping[str, Sequence[str]]) -> DataFrame:
    """table, inserted, changed, unchanged and deleted of a commit."""
    kinds = ("inserted", "changed", "unchanged", "deleted")
    rows = [(t, *(commit.counts.get(t, {}).get(k, 0) for k in kinds)) for t in tables]
    return spark.createDataFrame(rows, "table string, " + ", ".join(f"{k} long" for k in kinds))


RECONCILED = {"entities": ["entity_id"], "observations": ["observation_id"], "snapshots": ["entity_id", "version"], "subscriptions": ["entity_id"]}


def reconcile(store: Store, merges: DataFrame) -> Commit:
    """Entities that turned out to be one (old_id, new_id; old ids are no new ones), in one commit.

    Observations are repointed. Snapshots of both are one sequence of versions, by the time they were made (at).
    Of subscriptions the earliest due time holds. Merged entities stay, marked merged, with the one that took them in.
    """
    old = merges.select(F.col("old_id").alias("entity_id"))
    both = settled(old.unionByName(merges.select(F.col("new_id").alias("entity_id"))).distinct(), "reconciled")

    def plan(v: Version) -> dict[str, Change]:
        def moved(table: str) -> tuple[DataFrame, DataFrame]:
            """Rows of the entities that are concerned, as they are and under their new id."""
            rows = v.read(table).join(both, "entity_id", "left_semi")
            m = merges.select(F.col("old_id").alias("entity_id"), "new_id")
            return rows, rows.join(m, "entity_id", "left").withColumn("entity_id", F.coalesce("new_id", "entity_id")).drop("new_id").select(*rows.columns)

        out = {}
        m = merges.select(F.col("old_id").alias("entity_id"), "new_id")
        out["entities"] = Change(v.read("entities").join(m, "entity_id").withColumns({"status": F.lit("merged"), "merged_into": F.col("new_id")}).drop("new_id"))
        out["observations"] = Change(moved("observations")[1])
        before, after = moved("snapshots")
        versions = F.row_number().over(Window.partitionBy("entity_id").orderBy("at", "content")).cast("long")
        after = settled(after.withColumn("version", versions), "snapshots")
        out["snapshots"] = Change(after, before.join(after, ["entity_id", "version"], "left_anti").select("entity_id", "version"))
        before, after = moved("subscriptions")
        after = settled(after.groupBy("entity_id").agg(F.min("due").alias("due")), "subscriptions")
        out["subscriptions"] = Change(after, before.join(after, "entity_id", "left_anti").select("entity_id"))
        return out

    return store.commit(plan, reads=list(RECONCILED))
