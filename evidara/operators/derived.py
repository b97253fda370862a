"""What is derived of evidence, kept in step with it: chunks, postings, vectors, timelines and episodes.

Parents of any family (message, document, page and so on) are one table; a delta of them is carried
through all that depends on it, by keys, and all of it is one commit of a Store. A reader holds one version
and sees parents, chunks, index segments and vectors that belong together, also while another
generation is built. Work follows the delta: only the parts that hold its keys are read, only chunks whose
content is new are embedded, only rows that differ are written.

    parents -> chunks -> vectors, ledger, cells          (by parent, by chunk)
    parents -> index segments                            (one more for each delta; compact() makes one of all)
    parents with a conversation -> timeline -> episodes  (by conversation)
"""

from __future__ import annotations

import secrets
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import embedded
from ..sources.scratch import settled
from .lexical import chunk_count, fixed_chunks
from .lexical_index import LexicalIndex
from .store import Change, Commit, Staged, Store, Version, brief, delete, names_in
from .vector_store import KEYS as VECTOR_KEYS
from .vector_store import VectorStore, fitted_centers, matrix
from .windows import episodes

PARENT = "citation string, source_type string, conversation string, at long, actor string, title string, content string"
TABLES = {"parents": ["citation"], "chunks": ["parent", "chunk_index"], "timeline": ["conversation", "citation"], "episodes": ["conversation", "center"], **VECTOR_KEYS}
PLACES = {"chunks": "#parent", "timeline": "#conversation", "episodes": "#conversation", "vectors": "cell"}
FIELDS = ["content", "title", "actor"]
SEGMENTS = "lexical"


class Delta(NamedTuple):
    parents: DataFrame
    gone: DataFrame
    changes: dict[str, Change | Staged]


def chunks_of(parents: DataFrame) -> DataFrame:
    c = fixed_chunks(parents.filter("content is not null"), "citation", "content")
    return c.select(F.substring_index("citation", "#chunk-", 1).alias("parent"), F.col("chunk_index").cast("long").alias("chunk_index"), "source_type", "title", "actor", F.col("chunk").alias("content"))


def vector_rows(chunks: DataFrame) -> DataFrame:
    """key, content_hash and source_type of chunks, beside the content that the vector is made of."""
    return chunks.select(F.concat("parent", F.lit("#chunk-"), F.col("chunk_index").cast("string")).alias("key"), F.sha2("content", 256).alias("content_hash"), "content", "source_type")


def episodes_of(timeline: DataFrame) -> DataFrame:
    line = F.concat(F.col("actor"), F.lit(": "), F.substring("content", 1, 220))
    return episodes(timeline, "conversation", "at", line)


class Derived:
    def __init__(self, store: Store, cells: int = 16):
        self.store, self.spark, self.cells = store, store.spark, cells
        self.vectors = VectorStore(store)
        self.index_root = f"{store.root}/lexical"

    def index(self, version: Version | None = None) -> LexicalIndex:
        """The trigram index of the parents of a version."""
        v = version or self.store.version()
        return LexicalIndex(self.spark, self.index_root, "citation", FIELDS, v.attached.get(SEGMENTS, []))

    def _delta(self, v: Version, upserts: DataFrame, deletes: DataFrame | None) -> Delta:
        columns = [c.split()[0] for c in PARENT.split(", ")]
        upserts = upserts.select(*columns)
        if "parents" not in v.tables:
            return self._first(v, upserts)
        upserts = settled(upserts, "upserts")
        short = F.struct(*map(brief, upserts.schema.fields))
        old = v.near("parents", upserts).select("citation", "conversation", short.alias("__old"))
        fresh = upserts.join(old.select("citation", "__old"), "citation", "left").filter(~short.eqNullSafe(F.col("__old"))).drop("__old")
        fresh = settled(fresh, "fresh")
        gone = self.spark.createDataFrame([], "citation string, conversation string")
        if deletes is not None:
            named = deletes.select("citation").distinct().join(upserts.select("citation"), "citation", "left_anti")
            gone = v.lookup("parents", settled(named, "named")).select("citation", "conversation")
        gone = settled(gone, "gone")
        changes = {"parents": Change(fresh, gone.select("citation"), differs=True)}

        dirty = fresh.select(F.col("citation").alias("parent")).unionByName(gone.select(F.col("citation").alias("parent")))
        chunks = settled(chunks_of(fresh), "chunks")
        before = v.lookup("chunks", dirty)
        lost = None
        if before is not None:
            lost = settled(before.join(chunks, TABLES["chunks"], "left_anti").select(*TABLES["chunks"]), "lost")
        changes["chunks"] = Change(chunks, lost)
        if "cells" in v.tables:
            dropped = None if lost is None else lost.select(F.concat("parent", F.lit("#chunk-"), F.col("chunk_index").cast("string")).alias("key"))
            rows = vector_rows(chunks)
            changes |= self.vectors.changes(v, rows, dropped, embedded("content"))

        # A row that left a conversation, or moved in it, is taken out of where it was.
        was = old.drop("__old").join(fresh.select("citation"), "citation", "left_semi").unionByName(gone).filter("conversation is not null").select("conversation", "citation")
        now = fresh.filter("conversation is not null").select("conversation", "citation", "at", "actor", "content")
        was = settled(was.join(now.select("conversation", "citation"), ["conversation", "citation"], "left_anti"), "was")
        changes["timeline"] = Change(now, was)
        talks = now.select("conversation").unionByName(was.select("conversation")).distinct()
        lines = v.lookup("timeline", talks)
        kept = now if lines is None else lines.join(now.select("citation"), "citation", "left_anti").join(was, ["conversation", "citation"], "left_anti").unionByName(now)
        made = settled(episodes_of(kept), "episodes")
        earlier = v.lookup("episodes", talks)
        changes["episodes"] = Change(made, None if earlier is None else earlier.join(made, TABLES["episodes"], "left_anti").select(*TABLES["episodes"]))
        return Delta(fresh, gone, changes)

    def _first(self, v: Version, parents: DataFrame) -> Delta:
        """Where nothing is held: parents are written as their parts, and what follows is made of these."""
        staged, fresh = self.store.stage(v, "parents", Change(parents), TABLES["parents"])
        sizes = fresh.filter("content is not null").select(F.col("citation").alias("parent"), chunk_count(F.col("content")).alias("n"))
        timeline = fresh.filter("conversation is not null").select("conversation", "citation", "at", "actor", "content")
        made = settled(episodes_of(timeline), "episodes")
        changes = {"parents": staged, "chunks": Change(chunks_of(fresh), None, sizes), "timeline": Change(timeline), "episodes": Change(made)}
        return Delta(fresh, self.spark.createDataFrame([], "citation string"), changes)

    def apply(self, upserts: DataFrame, deletes: DataFrame | None = None, once: tuple[str, int] | None = None) -> Commit:
        """A delta of parents (PARENT, one row for each citation; citations that go), and all that follows of it."""
        seen: list[Delta] = []

        def plan(v: Version) -> Mapping[str, Change | Staged]:
            seen[:] = [self._delta(v, upserts, deletes)]
            return seen[0].changes

        def attach(v: Version) -> dict[str, object]:
            fresh, gone, _ = seen[0]
            if not fresh.limit(1).count() and not gone.limit(1).count():
                return {}
            have = v.attached.get(SEGMENTS, [])
            n = self.index(v).segment(self._next(have), fresh, gone.select("citation"), dealt="parents" in v.tables)
            return {SEGMENTS: [*have, n]}

        done = self.store.commit(plan, TABLES, PLACES, ["parents"], once, attach)
        if "cells" not in self.store.version().tables:
            self.rebuild_vectors()
        return done

    @staticmethod
    def _next(have: list[int]) -> int:
        """A number above all that are named, and different from that of any other writer at work."""
        return ((max(have, default=0) >> 20) + 1) << 20 | secrets.randbelow(1 << 20)

    def rebuild_vectors(self) -> Commit | None:
        """Vectors of all chunks in fresh cells; readers see the old ones until the commit."""
        chunks = self.store.version().read("chunks")
        if chunks is None:
            return None
        return self.vectors.build(vector_rows(chunks).withColumn("vector", embedded("content")).drop("content"), self.cells)

    def rebuild(self) -> Commit:
        """Another generation of all that is derived, from the parents alone, made active in one commit."""

        def plan(v: Version) -> Mapping[str, Change]:
            parents = v.read("parents")
            chunks = settled(chunks_of(parents), "chunks")
            timeline = parents.filter("conversation is not null").select("conversation", "citation", "at", "actor", "content")
            rows = settled(vector_rows(chunks).withColumn("vector", embedded("content")).drop("content"), "vectors")
            sample = rows.orderBy(F.xxhash64("key"), "key").limit(50_000).select("vector").toArrow()  # bounded
            centers = fitted_centers(matrix(sample.column("vector")), self.cells) if sample.num_rows else None
            new = {"chunks": chunks, "timeline": timeline, "episodes": settled(episodes_of(timeline), "episodes")}
            if centers is not None:
                placed = settled(self.vectors._placed(rows, centers), "placed")
                new |= {"vectors": placed.select("key", "source_type", "vector", "cell"), "ledger": placed.select("key", "content_hash", "cell"), "cells": self.vectors._statistics(placed, centers)}
            out = {}
            for name, df in new.items():
                old = v.read(name)
                out[name] = Change(df, None if old is None else old.join(df, TABLES[name], "left_anti").select(*TABLES[name]))
            return out

        def attach(v: Version) -> dict[str, object]:
            return {SEGMENTS: [self.index(v).segment(self._next(v.attached.get(SEGMENTS, [])), v.read("parents"))]}

        return self.store.commit(plan, TABLES, PLACES, list(TABLES), None, attach)

    def orphans(self, version: Version | None = None) -> DataFrame:
        """kind and n of what refers to nothing: chunks, vectors, episodes and indexed keys without what they are made of."""
        v = version or self.store.version()
        mark = lambda df, key, name: df.select(F.col(key).alias("key"), *(F.lit(int(name == n)).alias(n) for n in ("made", "parent", "indexed", "vector", "known")))
        parents, chunks = v.read("parents"), v.read("chunks")
        keys = chunks.select(F.concat("parent", F.lit("#chunk-"), F.col("chunk_index").cast("string")).alias("key"))
        # All that names a key meets at it, in one pass for parents and one for chunks.
        of_parents = mark(parents, "citation", "parent").unionByName(mark(chunks, "parent", "made")).unionByName(mark(self.index(v).live(), "key", "indexed"))
        of_chunks = mark(keys, "key", "made").unionByName(mark(v.read("vectors"), "key", "vector")).unionByName(mark(v.read("ledger"), "key", "known"))
        met = lambda df: df.groupBy("key").agg(*(F.sum(n).alias(n) for n in df.columns[1:]))
        without = lambda a, b: F.coalesce(F.sum(F.when(F.col(b) == 0, F.col(a))), F.lit(0))
        p = met(of_parents).agg(without("made", "parent").alias("chunks"), without("indexed", "parent").alias("indexed"), without("parent", "indexed").alias("unindexed"))
        c = met(of_chunks).agg(without("vector", "made").alias("vectors"), without("made", "known").alias("unembedded"))
        lone = v.read("episodes").join(v.read("timeline"), "conversation", "left_anti") if "episodes" in v.tables else self.spark.range(0)
        row = p.crossJoin(c).crossJoin(lone.agg(F.count("*").alias("episodes")))
        kinds = ("chunks", "vectors", "unembedded", "episodes", "indexed", "unindexed")
        return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds))).alias("x")).select("x.kind", "x.n")

    def vacuum(self, keep: int = 1, older_than: float = 0) -> int:
        """Deletes parts and segments that none of the newest versions names."""
        gone = self.store.vacuum(keep, older_than)
        named = {n for k in self.store.numbers() for n in self.store.version(k).attached.get(SEGMENTS, [])}
        for folder in names_in(self.spark, self.index_root):
            if folder.startswith("segment-") and int(folder[8:]) not in named:
                delete(self.spark, f"{self.index_root}/{folder}")
                gone += 1
        return gone
