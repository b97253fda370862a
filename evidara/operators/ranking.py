"""Fusion and re-ranking of routes, and top-k by vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.vectors import cosine, inner
from ..sources.scratch import settled

#: What rounding to 9 places may hide between two scores, and how many scores and values a task holds at a time.
SLACK, SCORES, VALUES = 2e-9, 1 << 21, 1 << 21


def route(df: DataFrame, name: str, order: Sequence[Column], limit: int, key: str = "key") -> DataFrame:
    """The best rows of a route with their rank from 1; only limit rows reach the ranking."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).withColumn("route", F.lit(name)).select(key, "rank", "route")


def fuse_weighted(routes: DataFrame, bases: Mapping[str, float], key: str = "key") -> DataFrame:
    """Sum over routes of base - 0.01 * (rank - 1), and the routes that named the key."""
    base = reduce(lambda w, kv: w.when(F.col("route") == kv[0], F.lit(float(kv[1]))), list(bases.items())[1:], F.when(F.col("route") == next(iter(bases)), F.lit(float(next(iter(bases.values()))))))
    return routes.withColumn("__c", base - 0.01 * (F.col("rank") - 1)).groupBy(key).agg(F.sum("__c").alias("score"), F.array_sort(F.collect_set("route")).alias("paths"))


def fuse_rrf(routes: DataFrame, weights: Mapping[str, float] | None = None, key: str = "key", k: int = 60) -> DataFrame:
    """Sum over routes of weight / (k + rank); weights are 0.01 at least."""
    weights = weights or {}
    w = F.lit(1.0)
    for name, value in weights.items():
        w = F.when(F.col("route") == name, F.lit(max(value, 0.01))).otherwise(w)
    return routes.withColumn("__c", w / (k + F.col("rank"))).groupBy(key).agg(F.sum("__c").alias("score"), F.array_sort(F.collect_set("route")).alias("paths"))


def feature_score(
    content: Column, title: Column, phrase: str, terms: Sequence[str], expansions: Sequence[str], paths: Column,
    others: Sequence[str] = (), filters: Mapping[str, object] | None = None, sender: str = "sender",
) -> Column:
    """Boosts for the phrase, its place, terms, expansions, the routes that found a row, and filters that it meets.

    others are further columns whose text counts for the phrase and terms. The values are fixed.
    """
    # The boosts below.
    text = F.lower(F.concat_ws("\n", content, title, *others))
    has = lambda c, t: F.lower(c).contains(t.lower())
    add = lambda cond, w: F.when(cond, w).otherwise(0.0)
    score = add(text.contains(phrase.lower()), 6.0) + F.when(has(title, phrase), 2.5).when(has(content, phrase), 0.75).otherwise(0.0)
    for t in terms:
        score = score + add(text.contains(t.lower()), 1.25)
    for t in expansions:
        score = score + add(text.contains(t.lower()), 0.45)
    for name, w in (("exact", 1.0), ("evidence", 0.8), ("vector", 0.4)):
        score = score + add(F.array_contains(paths, name), w)
    for name, value in (filters or {}).items():
        if value is None or value == "" or name in ("since", "until"):
            continue
        if name == "sender":
            score = score + add(F.col(sender).contains(str(value)), 0.5)
        elif name in ("source_family", "scope_type"):
            score = score + add(F.lit(value == "all") | (F.col("source_type") == F.lit(value)), 0.7)
        else:
            score = score + add(F.col(name) == F.lit(value), 0.7 if name == "source_type" else 0.4)
    return score


def rerank_head(fused: DataFrame, score: Column, window: int, key: str = "key") -> DataFrame:
    """The first window rows of the fused order by score, the others after them by their fused score.

    fused is a fused list, at most the depths of its routes together, so its order is one small window.
    """
    n = F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key)))
    out = fused.withColumn("tier", F.when(n <= window, 0).otherwise(1))
    return out.withColumn("score", F.when(F.col("tier") == 0, score).otherwise(F.col("score")))


def top_vectors(vectors: DataFrame, query: DataFrame, k: int, key: str, metric: str = "cosine", floor: float | None = None) -> DataFrame:
    """The k nearest rows to the one vector of query (column `q`), after all filters; exact."""
    f = cosine if metric == "cosine" else inner
    d = vectors.join(F.broadcast(query)).withColumn("score", F.round(f(F.col("vector"), F.col("q")), 9)).drop("q")
    if floor is not None:
        d = d.filter(F.col("score") >= floor)
    return d.orderBy(F.desc("score"), key).limit(k)


def _summed(products: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, as the JVM adds them."""
    return np.cumsum(products, axis=1)[:, -1] + 0.0 if products.shape[1] else np.zeros(len(products))


def _one(norms: np.ndarray) -> np.ndarray:
    return np.where(norms == 0, 1.0, norms)


def _rows_of(column: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which of them are vectors of so many values, none null; the others are zeros."""
    known = pc.fill_null(pc.equal(pc.list_value_length(column), -1 if dims is None else dims), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims or 0))
    if known.any() and dims:
        flat = column.filter(pa.array(known)).flatten()
        out[known] = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        if flat.null_count:
            known[known] = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dims).any(axis=1)
            out[~known] = 0.0
    return out, known


def _nearest_rows(queries: list[Sequence[float] | None], k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (key, vector): i, key and cosine of rows that can be among the k nearest of query i after rounding.

    Products of matrices tell which rows can; these are scored as `cosine` does. Of rows of one score and query, the first k by key go on.
    """
    groups: dict[int | None, list[int]] = {}
    for i, q in enumerate(queries):
        groups.setdefault(None if q is None or any(x is None for x in q) else len(q), []).append(i)
    asked = [(n, np.array(own, np.int32), np.array([queries[i] for i in own], np.float64).reshape(len(own), -1) if n is not None else np.zeros((len(own), 0))) for n, own in groups.items()]
    step = max(1, SCORES // max(1, len(queries)))

    def part(keys: pa.Array, vectors: pa.Array, n: int | None, own: np.ndarray, q: np.ndarray, top: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, known = _rows_of(vectors, n)
        nx, nq = _one(np.sqrt(_summed(x * x))), _one(np.sqrt(_summed(q * q)))
        near = (q @ x.T) / (nq[:, None] * nx[None, :])
        near[:, ~known] = 0.0
        near[np.isnan(near)] = np.inf  # which sorts above all
        top[:] = np.partition(np.concatenate([top, near], axis=1), -k, axis=1)[:, -k:]
        c, r = np.nonzero(near >= top.min(axis=1)[:, None] - SLACK)
        width = max(1, VALUES // max(1, x.shape[1]))
        sums = [_summed(q[c[a : a + width]] * x[r[a : a + width]]) for a in range(0, len(c), width)]
        score = np.where(known[r], np.concatenate([*sums, np.zeros(0)]) / (nx[r] * nq[c]), 0.0)
        if len(c) > k * len(own) and (pa.types.is_integer(keys.type) or pa.types.is_string(keys.type)):
            place = np.empty(len(keys), np.int64)
            place[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
            order = np.lexsort((place[r], score, c))
            c, r, score = c[order], r[order], score[order]
            at = np.arange(len(c))
            same = np.r_[False, (c[1:] == c[:-1]) & ((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1])))]
            kept = at - np.maximum.accumulate(np.where(same, 0, at)) < k
            c, r, score = c[kept], r[kept], score[kept]
        yield pa.RecordBatch.from_arrays([pa.array(own[c]), keys.take(pa.array(r)), pa.array(score)], names=["i", "key", "score"])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [np.full((len(own), k), -np.inf) for _, own, _ in asked]
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                piece = batch.slice(a, step)
                for (n, own, q), top in zip(asked, tops):
                    with np.errstate(all="ignore"):
                        yield from part(piece.column("key"), piece.column("vector"), n, own, q, top)

    return apply


def top_vectors_many(vectors: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, block: int = 2048) -> DataFrame:
    """The k nearest rows for each of many query vectors (query_key, q), a block of queries at a time.

    The driver holds one block; its results, k rows for each query, are written before the next
    is read. A task multiplies a few of its rows at a time with the block, and keeps those that can be among the
    k nearest, so what is shuffled does not grow with the vectors of a task.
    """
    spark, schema = vectors.sparkSession, queries.select(query_key, "q").schema
    kind = vectors.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    out, held = None, []

    def ranked(rows: list) -> DataFrame:
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], StructType([StructField("i", IntegerType()), schema[query_key]]))
        pairs = vectors.select(F.col(key).alias("key"), F.col("vector").cast("array<double>").alias("vector"))
        found = pairs.mapInArrow(_nearest_rows([r[1] for r in rows], k), f"i int, key {kind}, score double")
        d = found.join(F.broadcast(names), "i").select(query_key, F.col("key").alias(key), F.round("score", 9).alias("score"))
        n = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
        return d.withColumn("rank", n).filter(F.col("rank") <= k)

    for row in queries.select(query_key, "q").toLocalIterator():
        held.append(tuple(row))
        if len(held) == block:
            done, held = settled(ranked(held), "nearest"), []
            out = done if out is None else out.unionByName(done)
    if held or out is None:
        last = ranked(held)
        out = last if out is None else out.unionByName(last)
    return out


def calibrated_floor(max_negative: float | None, min_positive: float | None) -> float | None:
    """The least score above every negative one, where all positives are above it; else none."""
    import math

    if max_negative is None or min_positive is None or not max_negative < min_positive:
        return None
    return math.nextafter(max_negative, math.inf)
