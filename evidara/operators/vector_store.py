"""A kept store of vectors in cells: exact nearest neighbours that read few cells, and deltas that write few.

Cells are those of spherical k-means on a bounded sample; every vector lies in the cell of its
nearest centre. Of a cell its centre, the least cosine of a member with it and the range of norms
are kept, which bound the score of any member with a query: by the angle to the centre less the
widest angle of the cell. A search reads the cells of best bounds, takes the k-th score that it
finds, and then reads the other cells whose bound reaches it; none of the rest can hold a row of the
result. Filters go with the scan of the cells; they lower the k-th score and not the bounds, so the
result is that of a full scan after the filter, whatever the cells. How many cells are read
depends on how the vectors lie: few of clustered ones, all of directions without any structure.

Tables (of a Store): vectors in parts by cell, ledger (key, content_hash, cell), cells. A delta looks up its
keys in the ledger, so equal contents write nothing, and rewrites the cells that rows leave or enter;
bounds of a cell only widen until the next build.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import passing, settled
from .store import Change, Commit, Store, Version

#: Rows of a cell on average, most cells, rows that centres are fitted on, and queries that go to all tasks at a time.
CELL_ROWS, MOST_CELLS, SAMPLE, BLOCK = 2_000, 4_096, 50_000, 256
#: What rounding may add to a score, in a search of 9 places.
SLACK = 2e-9
KEYS = {"vectors": ["cell", "key"], "ledger": ["key"], "cells": ["cell"]}


class Found(NamedTuple):
    rows: DataFrame
    cells_read: int
    cells: int


def matrix(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """Vectors as rows; vectors of other lengths, and values that are no finite numbers, are an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (len(lengths) and (lengths.min() != lengths.max() or lengths[0] != (dims or lengths[0]))):
        raise ValueError(f"vectors must all have {dims or 'as many'} values")
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), -1)
    if not np.isfinite(m).all():
        raise ValueError("vectors must be finite")
    return m


def units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions, and norms; a zero vector has no direction and stays zero."""
    norms = np.linalg.norm(m, axis=1)
    return m / np.where(norms == 0, 1, norms)[:, None], norms


def fitted_centers(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means, begun far apart."""
    x, _ = units(sample)
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(x)))
    chosen = [int(rng.integers(len(x)))]
    near = x @ x[chosen[0]]
    for _ in range(cells - 1):
        away = np.maximum(1 - near, 0)
        at = int(rng.choice(len(x), p=away / away.sum())) if away.sum() > 0 else int(rng.integers(len(x)))
        chosen.append(at)
        near = np.maximum(near, x @ x[at])
    centers = x[chosen]
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        centers = np.where(norms[:, None] > 0, sums / np.where(norms == 0, 1, norms)[:, None], centers)
    return centers


def score_bounds(cosines: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray, query_norms: np.ndarray, metric: str) -> np.ndarray:
    """The highest score that a member of each cell (row) can have with each query (column), from the cosines of centre and query."""
    gap = np.arccos(np.clip(cosines, -1, 1)) - np.arccos(np.clip(least, -1, 1))[:, None]
    best = np.where(gap <= 0, 1.0, np.cos(np.clip(gap, 0, math.pi)))
    if metric == "cosine":
        return np.maximum(best, 0) if (low == 0).any() else best  # zero vectors score 0
    return query_norms[None, :] * np.where(best >= 0, high[:, None] * best, low[:, None] * best)


class VectorStore:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    # building and deltas

    def build(self, rows: DataFrame, cells: int | None = None) -> Commit:
        """Rows (key, content_hash, vector, and any columns to filter by) as the content of the store, in fresh cells, in one commit."""
        with passing(self.spark):
            return self._build(rows, cells)

    def _build(self, rows: DataFrame, cells: int | None) -> Commit:
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
        n = rows.count()
        sample = self._sample(rows, n)
        centers = fitted_centers(matrix(sample.column("vector")), cells or min(MOST_CELLS, -(-n // CELL_ROWS))) if n else np.zeros((0, 0))
        placed = settled(self._placed(rows, centers), "placed")
        columns = [c for c in placed.columns if c not in ("cosine", "norm", "content_hash")]
        stats = self._statistics(placed, centers)
        new = {"vectors": placed.select(*columns), "ledger": placed.select("key", "content_hash", "cell"), "cells": stats}

        def plan(v: Version) -> dict[str, Change]:
            out = {}
            for name, df in new.items():
                old = v.read(name)
                out[name] = Change(df, None if old is None else old.select(*KEYS[name]).join(df.select(*KEYS[name]), KEYS[name], "left_anti"))
            return out

        return self.store.commit(plan, keys=KEYS, places={"vectors": "cell"}, reads=list(KEYS))

    def _sample(self, rows: DataFrame, n: int) -> pa.Table:
        """The vectors of the SAMPLE rows with the least hashes of their keys. Of many rows only those below a hash
        that some more than these are expected under are looked at; should they be fewer, all are."""
        order = F.xxhash64("key")
        few = rows.filter(order < F.lit(int((1.2 * SAMPLE / n - 0.5) * 2**64))) if n > 2 * SAMPLE else rows
        sample = few.orderBy(order, "key").limit(SAMPLE).select("vector").toArrow()  # bounded
        return sample if sample.num_rows == min(n, SAMPLE) else rows.orderBy(order, "key").limit(SAMPLE).select("vector").toArrow()

    def apply(self, upserts: DataFrame, deletes: DataFrame | None = None, once: tuple[str, int] | None = None) -> Commit:
        """A delta of rows like those of build, one for each key, and of keys that go. Counts are those of the ledger."""
        with passing(self.spark):
            upserts = settled(upserts.withColumn("vector", F.col("vector").cast("array<double>")), "delta")
            return self.store.commit(lambda v: self.changes(v, upserts, deletes), reads=["ledger", "cells"], once=once)

    def changes(self, v: Version, upserts: DataFrame, deletes: DataFrame | None = None, vector: Column | None = None) -> dict[str, Change]:
        """What a delta does to the tables, for commits with other tables; vector is worked out of rows that are new or changed only."""
        if "cells" not in v.tables:
            raise ValueError("the store has not been built")
        asked = upserts.select("key") if deletes is None else upserts.select("key").unionByName(deletes.select("key"))
        ledger = settled(v.lookup("ledger", asked), "ledger").withColumnRenamed("cell", "old_cell")
        held = v.read("cells").orderBy("cell").toArrow()
        centers = matrix(held.column("center"))
        known = upserts.join(ledger.withColumnRenamed("content_hash", "old_hash"), "key", "left")
        fresh = known.filter(~F.col("content_hash").eqNullSafe(F.col("old_hash"))).drop("old_hash")
        fresh = fresh if vector is None else fresh.withColumn("vector", vector)
        placed = settled(self._placed(fresh, centers), "placed")
        columns = [f for f in v.read("vectors").columns]
        left = placed.filter("old_cell <> cell").select(F.col("old_cell").alias("cell"), "key")
        gone = None
        if deletes is not None:
            gone = settled(deletes.select("key").distinct().join(upserts.select("key"), "key", "left_anti").join(ledger, "key"), "gone")
            left = left.unionByName(gone.select(F.col("old_cell").alias("cell"), "key"))
        entered = self._statistics(placed, centers).drop("center")
        out = placed.filter("old_cell is not null").select(F.col("old_cell").alias("cell"))
        out = (out if gone is None else out.unionByName(gone.select(F.col("old_cell").alias("cell")))).groupBy("cell").agg(F.count("*").alias("out"))
        now = v.read("cells").join(entered.select("cell", *(F.col(c).alias(f"new_{c}") for c in ("least", "low", "high", "n"))), "cell", "left").join(out, "cell", "left")
        now = now.filter("new_n is not null or out is not null")
        empty = F.col("n") == 0  # of which the range of norms says nothing
        wide = now.select(
            "cell",
            "center",
            F.when(empty, F.col("new_least")).otherwise(F.least("least", "new_least")).alias("least"),
            F.when(empty, F.col("new_low")).otherwise(F.least("low", "new_low")).alias("low"),
            F.when(empty, F.col("new_high")).otherwise(F.greatest("high", "new_high")).alias("high"),
            (F.col("n") + F.coalesce("new_n", F.lit(0)) - F.coalesce("out", F.lit(0))).alias("n"),
        )
        return {
            "vectors": Change(placed.select(*columns), left, differs=True),
            "ledger": Change(placed.select("key", "content_hash", "cell"), None if gone is None else gone.select("key"), differs=True),
            "cells": Change(wide),
        }

    def _placed(self, rows: DataFrame, centers: np.ndarray) -> DataFrame:
        """Rows with the cell of the nearest centre, the cosine with it, and the norm."""
        held = self.spark.sparkContext.broadcast(centers)

        def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            for batch in batches:
                if batch.num_rows:
                    x, norms = units(matrix(batch.column(batch.schema.get_field_index("vector")), c.shape[1] if len(c) else None))
                    near = x @ c.T
                    own = near.argmax(axis=1)
                    cosine = np.where(norms == 0, 1.0, near[np.arange(len(own)), own])  # a zero vector has no angle, and its norm tells
                    made = pa.array(own), pa.array(cosine), pa.array(norms)
                    yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "cell", "cosine", "norm"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell long, cosine double, norm double"
        return rows.mapInArrow(apply, schema)

    def _statistics(self, placed: DataFrame, centers: np.ndarray) -> DataFrame:
        """cell, center, least cosine, lowest and highest norm, and n, of the cells with a row."""
        rows = [(i, c.tolist()) for i, c in enumerate(centers)]
        names = self.spark.createDataFrame(rows, "cell long, center array<double>")
        of_cell = placed.groupBy("cell").agg(F.min("cosine").alias("least"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.count("*").alias("n"))
        full = names.join(of_cell, "cell", "left")
        if "old_cell" in placed.columns:  # of a delta: only the cells that it enters
            return full.filter("n is not null")
        return full.fillna({"least": 1.0, "low": 0.0, "high": 0.0, "n": 0})

    # search

    def search(
        self, queries: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, floor: float | None = None, version: Version | None = None,
    ) -> Found:
        """query, key, score and rank of the k best rows for each query (query, q): exact; ties by key.

        where filters rows before they are ranked; floor is inclusive. Queries go to all tasks in blocks of BLOCK.
        """
        if metric not in ("cosine", "inner"):
            raise ValueError(metric)
        v = version or self.store.version()
        if "cells" not in v.tables:  # nothing was ever put in
            queries = queries.limit(0)
        out, read, cells = None, 0, 0
        kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
        key_kind = dict(v.read("ledger").dtypes)["key"] if "ledger" in v.tables else "long"
        schema = f"query {kinds['query']}, key {key_kind}, score double"
        held: list = []
        for row in [*queries.select("query", "q").toLocalIterator(), None]:
            if row is not None:
                held.append(row)
            if held and (row is None or len(held) == BLOCK):
                found, some, cells = self._block(v, held, k, metric, where, floor, schema)
                out, read, held = found if out is None else out.unionByName(found), read + some, []
        empty = self.spark.createDataFrame([], schema + ", rank long")
        return Found(empty if out is None else out, read, cells)

    def _block(self, v: Version, rows: list, k: int, metric: str, where: Column | None, floor: float | None, schema: str):
        names = [r["query"] for r in rows]
        q = np.array([r["q"] for r in rows], np.float64)
        if not np.isfinite(q).all():
            raise ValueError("queries must be finite")
        unit, norms = units(q)
        held = self.spark.sparkContext.broadcast((q if metric == "inner" else unit, unit, norms))

        def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, directions, lengths = held.value
            for batch in batches:
                if batch.num_rows:
                    c = matrix(batch.column("center"), directions.shape[1])
                    number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    b = score_bounds(c @ directions.T, number("least"), number("low"), number("high"), lengths, metric)
                    m = len(lengths)
                    yield pa.RecordBatch.from_pydict({"cell": np.repeat(number("cell"), m), "n": np.repeat(number("n"), m), "i": np.tile(np.arange(m, dtype=np.int32), len(b)), "bound": b.ravel()})

        cells = v.read("cells").filter("n > 0")
        of_pairs = settled(cells.mapInArrow(bounds, "cell long, n long, i int, bound double"), "bounds")
        before = F.sum("n").over(Window.partitionBy("i").orderBy(F.desc("bound"), "cell").rowsBetween(Window.unboundedPreceding, -1))
        first = settled(of_pairs.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < k).select("cell", "i"), "first")
        found = self._scored(v, first, held, k, where, metric)
        best = settled(self._best(found, k, floor), "best")
        reached = best.groupBy("i").agg(F.min("score").alias("kth"), F.count("*").alias("found")).filter(F.col("found") == k).select("i", "kth")
        rest = of_pairs.join(first, ["cell", "i"], "left_anti").join(F.broadcast(reached), "i", "left")
        limit = F.greatest(F.coalesce("kth", F.lit(-math.inf)), F.lit(-math.inf if floor is None else floor)) - SLACK * (1 + F.abs("bound"))
        second = settled(rest.filter(F.col("bound") >= limit).select("cell", "i"), "second")
        more = self._scored(v, second, held, k, where, metric)
        n = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "key"))
        top = self._best(best.select("i", "key", "score").unionByName(self._best(more, k, floor).select("i", "key", "score")), k, floor).withColumn("rank", n.cast("long"))
        of_block = self.spark.createDataFrame(list(enumerate(names)), f"i int, query {schema.split(',')[0].split()[1]}")
        read = first.unionByName(second).select("cell").distinct().count()
        return settled(top.join(F.broadcast(of_block), "i").select("query", "key", "score", "rank"), "nearest"), read, cells.count()

    def _best(self, found: DataFrame, k: int, floor: float | None) -> DataFrame:
        found = found.withColumn("score", F.round("score", 9))
        found = found if floor is None else found.filter(F.col("score") >= floor)
        n = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "key"))
        return found.withColumn("rank", n).filter(F.col("rank") <= k)

    def _scored(self, v: Version, pairs: DataFrame, held, k: int, where: Column | None, metric: str) -> DataFrame:
        """i, key and score of the rows of some cells (cell, i) that can be among the k best of their batch for query i."""
        asked = pairs.groupBy("cell").agg(F.collect_list("i").alias("asked"))  # of a block of queries at most
        cells = [r[0] for r in asked.select("cell").collect()]  # numbers of cells
        rows = v.part("vectors", cells)
        kind = dict(rows.dtypes)["key"]
        rows = rows if where is None else rows.filter(where)

        def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = held.value[0]
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell = batch.column("cell").to_numpy()
                edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), batch.num_rows]
                for a, b in zip(edges, edges[1:]):
                    part = batch.slice(a, b - a)
                    mine = np.array(part.column("asked")[0].as_py())
                    x = matrix(part.column("vector"), q.shape[1])
                    scores = (x if metric == "inner" else units(x)[0]) @ q[mine].T
                    if not np.isfinite(scores).all():
                        raise ValueError("scores must be finite")
                    if len(x) > k:
                        kth = np.partition(scores, len(x) - k, axis=0)[len(x) - k]
                        row, column = np.nonzero(scores >= kth - SLACK)
                    else:
                        row, column = (z.ravel() for z in np.indices(scores.shape))
                    yield pa.RecordBatch.from_arrays([pa.array(mine[column].astype(np.int32)), part.column("key").take(pa.array(row)), pa.array(scores[row, column])], names=["i", "key", "score"])

        return rows.select("cell", "key", "vector").join(F.broadcast(asked), "cell").mapInArrow(apply, f"i int, key {kind}, score double")
