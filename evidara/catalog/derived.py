"""Deltas carried through all that is derived of seven families of evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators.derived import Derived
from ..operators.store import Store
from ..sources import tables as S
from ..sources.scratch import shared_place
from .registry import query


def parents_of(spark, d):
    """Rows of seven tables as parents."""

    def family(table, source_type, key, content, title, actor, conversation=None, at=None):
        return S.raw(spark, d, table).select(
            F.concat(F.lit(f"{source_type}/"), *key).alias("citation"), F.lit(source_type).alias("source_type"), (F.lit(None) if conversation is None else conversation).cast("string").alias("conversation"),
            (F.lit(None) if at is None else at).cast("long").alias("at"), F.col(actor).cast("string").alias("actor"), F.col(title).cast("string").alias("title"), F.col(content).alias("content"),
        )

    s = lambda c: F.col(c).cast("string")
    return reduce(lambda a, b: a.unionByName(b), [
        family("conversations", "message", [s("conv_id"), F.lit("/"), s("turn")], "text", "conv_id", "role", F.col("conv_id"), F.col("turn")),
        family("documents", "document", [s("doc_id")], "text", "source", "lang"),
        family("pages", "page", [s("page_id")], "html", "url", "url"),
        family("events", "interaction", [s("event_id")], "props", "event_type", "user_id"),
        family("benchmark", "item", [s("item_id")], "text", "item_id", "item_id"),
        family("customer", "customer", [s("c_custkey")], "c_name", "c_mktsegment", "c_nationkey"),
        family("supplier", "supplier", [s("s_suppkey")], "s_name", "s_nationkey", "s_nationkey"),
    ])


_made: dict[tuple[str, str], tuple] = {}


def after_deltas(spark, d):
    """The tables after the delta, made once for all queries of a session over a folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _made:
        _made[key] = with_delta(spark, d)
    return _made[key]


def with_delta(spark, d):
    """All but some rows, then a delta: the missing ones come, every thirteenth document is another text, every seventeenth goes."""
    p = parents_of(spark, d)
    number = F.coalesce(F.regexp_extract("citation", r"(\d+)(?:/\d+)?$", 1).cast("long"), F.lit(0))
    p = p.withColumn("__n", number)
    kept = Derived(Store(spark, f"{shared_place(spark, 'derived')}/store"))
    kept.apply(p.filter("__n % 10 <> 3").drop("__n"))
    text = F.when((F.col("source_type") == "document") & (F.col("__n") % 13 == 0), F.concat(F.lit("new "), "content")).otherwise(F.col("content"))
    moved = p.filter("(__n % 10 = 3 or (source_type = 'document' and __n % 13 = 0)) and __n % 17 <> 5").withColumn("content", text).drop("__n")
    done = kept.apply(moved, p.filter("__n % 17 = 5").select("citation"))
    kept.vacuum()
    return kept, done


_N = "greatest(CAST(ceil((length(t) - 120) / 780.0) AS BIGINT), 1)"
_FINAL = """p AS (SELECT 'message' AS source_type, conv_id AS n, text AS t FROM conversations UNION ALL SELECT 'document', doc_id, CASE WHEN doc_id % 13 = 0 THEN 'new ' || text ELSE text END FROM documents UNION ALL SELECT 'page', page_id, html FROM pages
 UNION ALL SELECT 'interaction', event_id, props FROM events UNION ALL SELECT 'item', CAST(regexp_extract(CAST(item_id AS VARCHAR), '(\\d+)$', 1) AS BIGINT), text FROM benchmark UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier),
 q AS (SELECT * FROM p WHERE n % 17 <> 5)"""


@query("derived_families", f"WITH {_FINAL} SELECT source_type, count(*) AS parents, CAST(sum(CASE WHEN t IS NULL THEN 0 ELSE {_N} END) AS BIGINT) AS chunks, CAST(sum(CASE WHEN t IS NULL THEN 0 ELSE {_N} END) AS BIGINT) AS vectors FROM q GROUP BY 1")
def derived_families(spark, d):
    """Parents, chunks and vectors of each family after the delta."""
    v = after_deltas(spark, d)[0].store.version()
    counts = [v.read(t).groupBy("source_type").agg(F.count("*").alias(t)) for t in ("parents", "chunks", "vectors")]
    return reduce(lambda a, b: a.join(b, "source_type", "left"), counts).fillna(0)


@query("derived_chunks", f"""WITH {_FINAL}, k AS (SELECT n, t, unnest(range(0, {_N})) AS i FROM q WHERE source_type = 'document') SELECT n AS doc_id, i AS chunk_index, sha256(substring(t, i * 780 + 1, 900)) AS digest FROM k""")
def derived_chunks(spark, d):
    """Chunks of the documents after the delta."""
    c = after_deltas(spark, d)[0].store.version().read("chunks").filter("source_type = 'document'")
    return c.select(F.split("parent", "/")[1].cast("long").alias("doc_id"), "chunk_index", F.sha2("content", 256).alias("digest"))


@query("derived_episodes", """WITH m AS (SELECT conv_id, turn, role || ': ' || substring(text, 1, 220) AS line, row_number() OVER w AS rn FROM conversations WHERE conv_id % 17 <> 5 WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT CAST(conv_id AS VARCHAR) AS conversation, turn AS center, members, sha256(body) AS digest FROM (SELECT conv_id, turn, rn, string_agg(line, chr(10)) OVER e AS body, count(*) OVER e AS members FROM m WINDOW e AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) x WHERE (rn - 1) % 3 = 0""")  # fmt: skip
def derived_episodes(spark, d):
    """Episodes of the conversations after the delta."""
    e = after_deltas(spark, d)[0].store.version().read("episodes")
    return e.select("conversation", F.col("center").cast("int").alias("center"), "members", F.sha2("episode_text", 256).alias("digest"))


@query("derived_orphans", "SELECT unnest(['chunks', 'vectors', 'unembedded', 'episodes', 'indexed', 'unindexed']) AS kind, 0 AS n")
def derived_orphans(spark, d):
    """What refers to nothing, or is missing, in any of the kept tables and the index."""
    return after_deltas(spark, d)[0].orphans().withColumn("n", F.col("n").cast("int"))


@query("derived_work", f"""WITH {_FINAL}, a AS (SELECT *, n % 10 <> 3 AS had, n % 17 <> 5 AS stays, source_type = 'document' AND n % 13 = 0 AS anew FROM p)
 SELECT count(*) FILTER (WHERE NOT had AND stays) AS inserted, count(*) FILTER (WHERE had AND stays AND anew) AS changed, count(*) FILTER (WHERE had AND NOT stays) AS deleted FROM a""")  # fmt: skip
def derived_work(spark, d):
    """Parents that the delta writes."""
    n = after_deltas(spark, d)[1].counts["parents"]
    return spark.createDataFrame([tuple(n.get(k, 0) for k in ("inserted", "changed", "deleted"))], "inserted long, changed long, deleted long")
