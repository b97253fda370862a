"""Searches of the kept vector store in cells, and its deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.store import Store
from ..operators.vector_store import VectorStore
from ..sources import tables as S
from ..sources.scratch import shared_place
from .registry import query


def stored(spark, d, rows, cells=None):
    """A store in a fresh folder with rows (vec_id, vector, label)."""
    store = VectorStore(Store(spark, f"{shared_place(spark, 'cells')}/store"))
    store.build(rows.select(F.col("vec_id").alias("key"), F.sha2(F.concat_ws(",", "vector"), 256).alias("content_hash"), "vector", "label"), cells)
    return store


def queries_of(rows, every):
    return rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("vector").alias("q"))


COSINE = "round(list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 9)"


@query("cells_nearest", f"""SELECT a.vec_id AS query, b.vec_id AS key, {COSINE} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rank
 FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10""")  # fmt: skip
def cells_nearest(spark, d):
    """The ten nearest of every hundredth vector."""
    v = S.vectors(spark, d)
    return stored(spark, d, v).search(queries_of(v, 100), 10).rows


@query("cells_nearest_filtered", f"""SELECT a.vec_id AS query, b.vec_id AS key, {COSINE} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rank
 FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.label IN (3, 4) AND {COSINE} >= 0.1 QUALIFY rank <= 10""")  # fmt: skip
def cells_nearest_filtered(spark, d):
    """Rows of two labels with a score of 0.1 or more."""
    v = S.vectors(spark, d)
    return stored(spark, d, v).search(queries_of(v, 100), 10, where=F.col("label").isin(3, 4), floor=0.1).rows


AFTER = """(SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_reverse(CAST(embedding AS DOUBLE[])) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings WHERE vec_id % 11 <> 5)"""


def after_delta(spark, d):
    """Most vectors, then a delta: missing ones come, every seventh is another one, some come again as they are, others go."""
    v = S.vectors(spark, d)
    store = stored(spark, d, v.filter("vec_id % 10 <> 3"))
    delta = v.filter("(vec_id % 10 = 3 or vec_id % 7 = 0 or vec_id % 5 = 1) and vec_id % 11 <> 5")
    delta = delta.withColumn("vector", F.when(F.col("vec_id") % 7 == 0, F.reverse("vector")).otherwise(F.col("vector")))
    rows = delta.select(F.col("vec_id").alias("key"), F.sha2(F.concat_ws(",", "vector"), 256).alias("content_hash"), "vector", "label")
    return store, rows, v.filter("vec_id % 11 = 5").select(F.col("vec_id").alias("key"))


@query("cells_after_delta", f"""SELECT a.vec_id AS query, b.vec_id AS key, round(list_inner_product(b.v, CAST(a.embedding AS DOUBLE[])), 9) AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(b.v, CAST(a.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rank
 FROM embeddings a, {AFTER} b WHERE a.vec_id % 100 = 1 QUALIFY rank <= 5""")  # fmt: skip
def cells_after_delta(spark, d):
    store, rows, gone = after_delta(spark, d)
    store.apply(rows, gone)
    queries = S.vectors(spark, d).filter("vec_id % 100 = 1").select(F.col("vec_id").alias("query"), F.col("vector").alias("q"))
    return store.search(queries, 5, metric="inner").rows


@query("cells_delta_counts", """WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT i, i % 10 <> 3 AS had, CASE WHEN i % 7 = 0 THEN list_reverse(v) ELSE v END = v AS same FROM e WHERE (i % 10 = 3 OR i % 7 = 0 OR i % 5 = 1) AND i % 11 <> 5)
 SELECT count(*) FILTER (WHERE NOT had) AS inserted, count(*) FILTER (WHERE had AND NOT same) AS changed, (SELECT count(*) FROM e WHERE i % 10 <> 3 AND i % 11 = 5) AS deleted, 0 AS written_again FROM u""")  # fmt: skip
def cells_delta_counts(spark, d):
    """What the delta does to the ledger, and how many parts it writes when it is applied again."""
    store, rows, gone = after_delta(spark, d)
    n = store.apply(rows, gone).counts["ledger"]
    again = sum(map(len, store.apply(rows, gone).written.values()))
    row = (n.get("inserted", 0), n.get("changed", 0), n.get("deleted", 0), again)
    return spark.createDataFrame([row], "inserted long, changed long, deleted long, written_again int")
