"""Queries over tables of a Store: queues, linked upserts, purges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import linked as K
from ..operators.queue import RefreshQueue
from ..operators.store import Change, Store
from ..operators.windows import resequenced
from ..sources import tables as S
from ..sources.scratch import shared_place
from .registry import query


def fresh_store(spark, name):
    return Store(spark, f"{shared_place(spark, name)}/store")


@query("queue_states", """WITH q AS (SELECT user_id AS entity, min(ts) AS due FROM events WHERE event_type <> 'view' GROUP BY user_id),
 a AS (SELECT *, row_number() OVER (ORDER BY due, entity) AS n FROM q WHERE due <= TIMESTAMP '2024-01-15 00:00:00'),
 s AS (SELECT q.entity, q.due, coalesce(a.n <= 40, false) AS claimed FROM q LEFT JOIN a ON a.entity = q.entity)
 SELECT entity, CASE WHEN claimed AND entity % 3 = 1 THEN TIMESTAMP '2024-01-15 00:00:30' ELSE due END AS due, CASE WHEN claimed THEN 1 ELSE 0 END AS generation, CASE WHEN claimed AND entity % 3 = 1 THEN 1 ELSE 0 END AS attempts,
  'pending' AS state, claimed AND entity % 3 = 2 AS leased FROM s WHERE NOT (claimed AND entity % 3 = 0)""")  # fmt: skip
def queue_states(spark, d):
    """Users of events are queued, the first forty claimed: of these a third is done, a third failed, a third still at work."""
    e = S.raw(spark, d, "events").filter("event_type <> 'view'").select(F.col("user_id").alias("entity"), F.col("ts").alias("due"))
    q = RefreshQueue(fresh_store(spark, "queue"))
    q.enqueue(e)
    now = datetime(2024, 1, 15)
    got = q.claim(now, 300, limit=40)
    q.settle([c for c in got if c[0] % 3 == 0], [c for c in got if c[0] % 3 == 1], now)
    return q.read().select("entity", "due", F.col("generation").cast("int").alias("generation"), "attempts", "state", F.col("lease_until").isNotNull().alias("leased"))


# Media: the documents are assets, every second one known before; the batch brings two thirds, some as placeholders.
_ASSET = """'a' || doc_id AS asset_id, doc_id, lang, source, CASE WHEN doc_id % 4 = 1 THEN 'voice' ELSE 'image' END AS modality, sha256(text) AS h"""
_MEDIA = f"""WITH d AS (SELECT {_ASSET} FROM documents), b1 AS (SELECT *, 'cached' AS cache, CASE WHEN doc_id % 6 = 0 THEN 'done' ELSE 'pending' END AS proc FROM d WHERE doc_id % 2 = 0),
 known AS (SELECT lang, source, modality, h, min(asset_id) AS kept FROM b1 GROUP BY ALL),
 b2 AS (SELECT *, doc_id % 5 = 0 AS ph FROM d WHERE doc_id % 3 <> 1), r AS (SELECT b2.* EXCLUDE (asset_id), coalesce(CASE WHEN NOT ph THEN kept END, asset_id) AS asset_id FROM b2 LEFT JOIN known k ON k.lang = b2.lang AND k.source = b2.source AND k.modality = b2.modality AND k.h = b2.h),
 l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY doc_id DESC) = 1),
 n AS (SELECT l.asset_id, CASE WHEN ph THEN b1.h ELSE l.h END AS h, l.modality, CASE WHEN ph AND b1.asset_id IS NOT NULL THEN 'cached' WHEN ph THEN 'metadata_only' ELSE 'copied' END AS cache,
  CASE WHEN ph AND b1.proc = 'done' THEN 'done' ELSE 'pending' END AS proc, b1.asset_id IS NOT NULL AS had FROM l LEFT JOIN b1 ON b1.asset_id = l.asset_id)"""


def media(spark, d):
    docs = S.raw(spark, d, "documents")
    base = docs.select(
        F.concat(F.lit("a"), "doc_id").alias("asset_id"), F.col("lang").alias("account"), F.lit("doc").alias("source_type"), F.col("source").alias("source_id"), F.when(F.col("doc_id") % 4 == 1, "voice").otherwise("image").alias("modality"),
        F.lit("file").alias("media_type"), F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("string").alias("path_ref"), "doc_id", F.col("doc_id").alias("ordinal"),
    )
    g = K.MediaGraph(fresh_store(spark, "media"))
    old = base.filter("doc_id % 2 = 0").withColumns({"cache_state": F.lit("cached"), "processing_state": F.when(F.col("doc_id") % 6 == 0, "done").otherwise("pending"), "placeholder": F.lit(False)})
    link = lambda rows: rows.select(
        F.concat(F.lit("l"), "doc_id").alias("link_id"), "asset_id", F.when(F.col("doc_id") % 3 == 0, "private_chat").otherwise("group").alias("scope_type"), F.lit(True).alias("accepted"), F.lit("exact").alias("reason"), F.col("source_id").alias("source_citation"), "ordinal",
    )
    g.upsert(old, link(old))
    held = F.col("doc_id") % 5 == 0
    new = base.filter("doc_id % 3 <> 1").withColumns({"placeholder": held, "content_hash": F.when(~held, F.col("content_hash")), "cache_state": F.when(held, "metadata_only").otherwise("copied"), "processing_state": F.lit("pending")})
    return g, new, link(new)


@query("media_graph_assets", _MEDIA + """ SELECT asset_id, modality, cache AS cache_state, proc AS processing_state, h AS content_hash FROM n
 UNION ALL SELECT asset_id, modality, cache, proc, h FROM b1 WHERE asset_id NOT IN (SELECT asset_id FROM n)""")  # fmt: skip
def media_graph_assets(spark, d):
    """Assets known by content keep their id, placeholders take nothing back."""
    g, assets, links = media(spark, d)
    g.upsert(assets, links)
    return g.store.version().read("assets").select("asset_id", "modality", "cache_state", "processing_state", "content_hash")


@query("media_graph_counts", _MEDIA + """, k AS (SELECT 'l' || r.doc_id AS link_id, r.asset_id, r.doc_id % 2 = 0 AS had, r.asset_id = 'a' || r.doc_id AS same, r.doc_id FROM r),
 v AS (SELECT a.asset_id FROM (SELECT asset_id, modality FROM n UNION ALL SELECT asset_id, modality FROM b1 WHERE asset_id NOT IN (SELECT asset_id FROM n)) a WHERE modality = 'voice' AND asset_id IN (SELECT asset_id FROM k WHERE doc_id % 3 = 0))
 SELECT 'assets' AS "table", count(*) FILTER (WHERE NOT had) AS inserted, count(*) FILTER (WHERE had AND cache <> 'cached') AS changed, count(*) FILTER (WHERE had AND cache = 'cached') AS unchanged, 0 AS deleted FROM n
 UNION ALL SELECT 'links', count(*) FILTER (WHERE NOT had), count(*) FILTER (WHERE had AND NOT same), count(*) FILTER (WHERE had AND same), 0 FROM k
 UNION ALL SELECT 'source_rows', 0, 0, 0, 0 UNION ALL SELECT 'jobs', (SELECT count(*) FROM v), 0, 0, 0 UNION ALL SELECT 'again', 0, 0, 0, 0""")  # fmt: skip
def media_graph_counts(spark, d):
    """Rows inserted, changed and found unchanged in each table, and what a replay writes."""
    g, assets, links = media(spark, d)
    first = g.upsert(assets, links)
    again = g.upsert(assets, links)
    extra = spark.createDataFrame([("again", *(again.counts["assets"].get(k, 0) + len(again.written) for k in ("inserted", "changed")), 0, 0)], "table string, inserted long, changed long, unchanged long, deleted long")
    return K.counts_of(spark, first, K.MEDIA).unionByName(extra)


@query("people_identifiers", """WITH e AS (SELECT c_custkey AS k, 'c' || c_custkey AS entity_id, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS name, CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 1 THEN 1.0 ELSE c_acctbal END AS conf FROM customer),
 o AS (SELECT 'c' || o_custkey AS entity_id, lower(o_orderpriority) AS v, max('order/' || o_orderkey) AS citation FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey IN (SELECT k FROM e) GROUP BY 1, 2)
 SELECT entity_id, 'display_name' AS identifier_type, name AS normalized_value, 'entity' AS source, conf AS confidence, NULL AS citation FROM e UNION ALL SELECT entity_id, 'alias', v, 'observation', 0.5, citation FROM o""")  # fmt: skip
def people_identifiers(spark, d):
    """Customers and what their orders say of them, in two batches; identifiers are made anew from both."""
    c = S.raw(spark, d, "customer")
    entities = c.select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.lit("person").alias("entity_type"), F.col("c_name").alias("display_name"), F.lit("active").alias("status"), F.col("c_acctbal").cast("double").alias("confidence"))
    o = S.raw(spark, d, "orders")
    observations = o.select(
        F.concat(F.lit("o"), "o_orderkey").alias("observation_id"), F.concat(F.lit("c"), "o_custkey").alias("entity_id"), F.lit("Alias").alias("observation_type"), F.col("o_orderpriority").alias("value"),
        F.when(F.col("o_orderkey") % 5 == 0, "retired").otherwise("active").alias("status"), F.lit(0.5).alias("confidence"), F.concat(F.lit("order/"), "o_orderkey").alias("citation"), "o_orderkey",
    )
    people = K.People(fresh_store(spark, "people"))
    people.upsert(entities, observations.filter("o_orderkey % 2 = 0"))
    people.upsert(entities.limit(0), observations.filter("o_orderkey % 2 = 1"))
    return people.store.version().read("identifiers")


_GONE = """WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (2, 3)), c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM n)), o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM c)),
 l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT k FROM o)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT k FROM n)),
 audit AS (SELECT 0 AS step, 'region' AS "table", 2 AS removed UNION ALL SELECT 1, 'nation', count(*) FROM n UNION ALL SELECT 2, 'customer', count(*) FROM c UNION ALL SELECT 3, 'supplier', count(*) FROM s
 UNION ALL SELECT 4, 'orders', count(*) FROM o UNION ALL SELECT 5, 'lineitem', count(*) FROM l)"""
_LINKS = [K.Link("nation", "n_regionkey", "region"), K.Link("customer", "c_nationkey", "nation"), K.Link("supplier", "s_nationkey", "nation"), K.Link("orders", "o_custkey", "customer"), K.Link("lineitem", "l_orderkey", "orders")]


@query("kept_purge_audit", _GONE + """ SELECT step, "table", CAST(removed AS BIGINT) AS removed, CASE "table" WHEN 'region' THEN (SELECT count(*) FROM region) WHEN 'nation' THEN (SELECT count(*) FROM nation) WHEN 'customer' THEN (SELECT count(*) FROM customer)
 WHEN 'supplier' THEN (SELECT count(*) FROM supplier) WHEN 'orders' THEN (SELECT count(*) FROM orders) ELSE (SELECT count(*) FROM lineitem) END - removed AS remaining, 0 AS dangling FROM audit""")  # fmt: skip
def kept_purge_audit(spark, d):
    """Two regions and all that depends on them go from kept tables, five levels deep; what each table lost and has left."""
    keys = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "n"]}
    columns = {"nation": ["n_regionkey"], "customer": ["c_nationkey"], "supplier": ["s_nationkey"], "orders": ["o_custkey"]}
    store = fresh_store(spark, "purge")
    rows = {t: S.raw(spark, d, t) for t in keys}
    rows["lineitem"] = resequenced(rows["lineitem"], ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey", into="n")  # line numbers repeat
    store.commit({t: Change(df.select(*keys[t], *columns.get(t, []))) for t, df in rows.items()}, keys)
    K.purge(store, "excluded regions", "region", spark.createDataFrame([(2,), (3,)], "r_regionkey long"), _LINKS)
    v = store.version()
    left = None
    for t in keys:
        n = v.read(t).agg(F.count("*").alias("remaining")).withColumn("table", F.lit(t))
        left = n if left is None else left.unionByName(n)
    dangling = K.dangling(v, _LINKS).agg(F.sum("n").cast("int").alias("dangling"))
    return v.read("audit").join(left, "table").join(F.broadcast(dangling)).select("step", "table", "removed", "remaining", "dangling")


_RECONCILED = """WITH m AS (SELECT c_custkey AS old_id, c_custkey - 1 AS new_id FROM customer WHERE c_custkey % 4 = 2), e AS (SELECT coalesce(new_id, user_id) AS entity, event_id, ts FROM events LEFT JOIN m ON old_id = user_id)
 SELECT 'observation' AS kind, entity, event_id AS n, 0 AS value FROM e
 UNION ALL SELECT 'snapshot', entity, row_number() OVER (PARTITION BY entity ORDER BY event_id), event_id FROM e WHERE event_id % 3 = 0
 UNION ALL SELECT 'subscription', entity, 0, CAST(epoch(min(date_trunc('second', ts))) AS BIGINT) FROM e GROUP BY entity
 UNION ALL SELECT 'entity', c_custkey, CASE WHEN new_id IS NULL THEN 0 ELSE 1 END, coalesce(new_id, 0) FROM customer LEFT JOIN m ON old_id = c_custkey"""


@query("reconciled_people", _RECONCILED)
def reconciled_people(spark, d):
    """Users found to be one: what was noted of them, their snapshots and subscriptions, and the marks of the merged, after one commit."""
    e = S.raw(spark, d, "events").select(F.col("user_id").alias("entity_id"), "event_id", F.unix_seconds(F.to_timestamp("ts")).alias("second"))
    store = fresh_store(spark, "reconciled")
    versions = resequenced(e.filter("event_id % 3 = 0").select("entity_id", F.col("event_id").alias("at"), F.col("event_id").alias("content")), ["entity_id"], "at")
    people = S.raw(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("merged_into"))
    store.commit({
        "entities": Change(people), "observations": Change(e.select(F.col("event_id").alias("observation_id"), "entity_id")), "snapshots": Change(versions),
        "subscriptions": Change(e.groupBy("entity_id").agg(F.min("second").alias("due"))),
    }, K.RECONCILED)
    merges = S.raw(spark, d, "customer").filter("c_custkey % 4 = 2").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") - 1).alias("new_id"))
    K.reconcile(store, merges)
    v = store.version()
    row = lambda t, kind, n, value: v.read(t).select(F.lit(kind).alias("kind"), F.col("entity_id").alias("entity"), n.cast("long").alias("n"), value.cast("long").alias("value"))
    out = row("observations", "observation", F.col("observation_id"), F.lit(0)).unionByName(row("snapshots", "snapshot", F.col("version"), F.col("content")))
    out = out.unionByName(row("subscriptions", "subscription", F.lit(0), F.col("due")))
    return out.unionByName(row("entities", "entity", (F.col("status") == "merged").cast("int"), F.coalesce("merged_into", F.lit(0))))


@query("folder_tick", """SELECT true AS changed, count(*) FILTER (WHERE doc_id % 10 = 3) AS added, count(*) FILTER (WHERE doc_id % 10 <> 3 AND doc_id % 7 = 0 AND doc_id % 11 <> 5) AS altered,
 count(*) FILTER (WHERE doc_id % 10 <> 3 AND doc_id % 11 = 5) AS removed, count(*) FILTER (WHERE NOT (doc_id % 10 <> 3 AND doc_id % 11 = 5)) AS files FROM documents""")  # fmt: skip
def folder_tick(spark, d):
    """Two listings of a folder, made of the documents: what was added, altered and removed between them."""
    from ..sources.readers import tick

    i = F.col("doc_id")
    files = S.raw(spark, d, "documents").select(i, F.concat(F.lit("doc/"), i).alias("path"), F.col("n_chars").alias("length"), F.lit(0).cast("timestamp").alias("modificationTime"))
    before = files.filter("doc_id % 10 <> 3").drop("doc_id")
    after = files.filter("doc_id % 10 = 3 or doc_id % 11 <> 5").withColumn("length", F.when(i % 7 == 0, F.col("length") + 1).otherwise(F.col("length"))).drop("doc_id")
    return tick(before, after).select("changed", "added", "altered", "removed", "files")


@query("eval_pack_cases", """SELECT CAST(item_id AS VARCHAR) AS case_id, CASE WHEN item_id % 2 = 0 THEN 'default' ELSE 'old' END AS category, sha256(text) AS digest, CASE WHEN item_id % 2 = 0 THEN 10 ELSE 5 END AS "limit",
 'item/' || item_id || CASE WHEN item_id % 2 = 1 THEN '' ELSE ',item/0' END AS expected FROM benchmark WHERE item_id % 5 <> 4""")  # fmt: skip
def eval_pack_cases(spark, d):
    """Cases of both schemas of an evaluation pack, written as JSON lines of the benchmark and read as one table; those without a question fall away."""
    from ..sources.readers import read_eval_pack

    i = F.col("item_id")
    item = F.concat(F.lit("item/"), i)
    text = F.when(i % 5 == 4, " ").otherwise(F.col("text"))
    listed = F.to_json(F.array(item, F.lit("item/0")))
    new = F.struct(F.lit(2).alias("schema_version"), i.cast("string").alias("case_id"), text.alias("query"), F.struct(listed.alias("expected_any_citation")).alias("oracle"))
    old = F.struct(F.lit(1).alias("schema_version"), i.cast("string").alias("id"), F.lit("old").alias("category"), text.alias("query"), F.lit(5).alias("limit"), item.alias("expected_citation"))
    path = f"{shared_place(spark, 'pack')}/pack"
    S.raw(spark, d, "benchmark").select(F.when(i % 2 == 0, F.to_json(new)).otherwise(F.to_json(old)).alias("value")).write.text(path)
    return read_eval_pack(spark, path).select("case_id", "category", F.sha2("query", 256).alias("digest"), F.col("limit").cast("int").alias("limit"), F.concat_ws(",", "expected").alias("expected"))
