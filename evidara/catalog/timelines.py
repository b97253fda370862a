"""Queries of timelines, message deltas, queues and rebuilt chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import incremental as I
from ..operators import lexical as L
from ..sources import tables as S
from ..sources import timeline as M
from .registry import query

#: Documents as timeline items: two documents are copies of one item, each under its own key and the next one's.
CLEAN = "regexp_replace(text, '[^\\p{L}\\p{N} ]+', ' ', 'g')"
ITEMS_SQL = f"""(SELECT CAST(doc_id // 2 AS VARCHAR) AS id, source AS author, doc_id // 3 AS sent, trim(regexp_replace({CLEAN}, ' +', ' ', 'g')) AS text, ['k' || doc_id, 'k' || (doc_id + 1)] AS keys, doc_id FROM documents WHERE doc_id % 11 <> 0)"""
BEST_SQL = f"""(SELECT id, first(author ORDER BY sent DESC, length(text) DESC, doc_id DESC) AS author, max(sent) AS sent, first(text ORDER BY sent DESC, length(text) DESC, doc_id DESC) AS text, list_sort(list_distinct(flatten(list(keys)))) AS keys, count(*) AS copies FROM {ITEMS_SQL} i GROUP BY id)"""


def items(spark, d):
    key = lambda n: F.concat(F.lit("<feedKey>k"), (F.col("doc_id") + n).cast("string"), F.lit("</feedKey>"))
    clean = F.regexp_replace("text", "[^\\p{L}\\p{N} ]+", " ")
    xml = F.concat(
        F.lit("<TimelineObject><id>"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("</id><username>"), "source", F.lit("</username><createTime>"), F.floor(F.col("doc_id") / 3).cast("string"),
        F.lit("</createTime><contentDesc>"), clean, F.lit("</contentDesc>"), key(0), key(1), F.lit("</TimelineObject>"),
    )
    broken = F.when(F.col("doc_id") % 11 == 0, F.lit("<TimelineObject><id>")).otherwise(xml)
    return S.raw(spark, d, "documents").select("doc_id", M.parsed_timeline(broken).alias("p")).select("doc_id", "p.*")


@query("timeline_items", f"SELECT id, author, sent AS at, sha256(text) AS digest, array_to_string(keys, ',') AS keys, copies FROM {BEST_SQL} b")
def timeline_items(spark, d):
    """Parsed from XML; copies of an item become one, with the keys of all."""
    best = M.one_of_each(items(spark, d).filter("status = 'parsed'"), "doc_id")
    return best.select("id", "author", "at", F.sha2("text", 256).alias("digest"), F.concat_ws(",", "keys").alias("keys"), "copies")


@query("timeline_statuses", "SELECT CASE WHEN doc_id % 11 = 0 THEN 'malformed' ELSE 'parsed' END AS status, count(*) AS n FROM documents GROUP BY 1")
def timeline_statuses(spark, d):
    return items(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("timeline_interactions", f"SELECT event_id, m.id AS item_id, m.id IS NULL AS orphan FROM events LEFT JOIN (SELECT k, min(id) AS id FROM (SELECT id, unnest(keys) AS k FROM {BEST_SQL} b) x GROUP BY k) m ON m.k = 'k' || (event_id % 1500)")
def timeline_interactions(spark, d):
    """Every interaction stays; those of no known item are told."""
    e = S.raw(spark, d, "events").select("event_id", F.concat(F.lit("k"), (F.col("event_id") % 1500).cast("string")).alias("feed_key"))
    return M.with_items(e, M.one_of_each(items(spark, d).filter("status = 'parsed'"), "doc_id"), "feed_key").select("event_id", "item_id", "orphan")


@query("image_evidence", """SELECT l.page_id, o.quality AS observation, m.source AS message_actor, t.lang AS timeline_lang, EXISTS (SELECT 1 FROM events e WHERE e.user_id = l.page_id AND e.event_type = 'view') AS interacted
 FROM (SELECT page_id, 'doc/' || page_id AS parent FROM pages WHERE page_id % 3 <> 0) l JOIN labels o ON o.doc_id = l.page_id LEFT JOIN documents m ON 'doc/' || m.doc_id = l.parent AND m.lang = 'en' LEFT JOIN documents t ON 'doc/' || t.doc_id = l.parent AND t.lang <> 'en'""")
def image_evidence(spark, d):
    """Observations of images with their accepted links, the message or timeline item that a link's citation hangs on, and whether its actor interacted."""
    page = F.col("page_id").cast("string")
    links = S.raw(spark, d, "pages").select("page_id", F.concat(F.lit("doc/"), page, F.lit("#image-"), page).alias("source_citation"), (F.col("page_id") % 3 != 0).alias("accepted"))
    observations = S.raw(spark, d, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("observation"))
    docs = S.raw(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("parent"), "lang", "source")
    linked = links.filter("accepted").withColumn("parent", M.bare_citation(F.col("source_citation"))).join(observations, "page_id")
    j = linked.join(docs.filter("lang = 'en'").select("parent", F.col("source").alias("message_actor")), "parent", "left")
    j = j.join(docs.filter("lang <> 'en'").select("parent", F.col("lang").alias("timeline_lang")), "parent", "left")
    views = S.raw(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("page_id"))
    from ..operators.joins import flagged

    return flagged(j, views, "page_id", "interacted").select("page_id", "observation", "message_actor", "timeline_lang", "interacted")


# Deltas -------------------------------------------------------------------------------------

#: What is there, a batch of one source (renames, edits, a title changed, new rows), what it deletes, and who owns what.
TARGET = "(SELECT conv_id AS conversation, turn AS local_id, 'msg/' || conv_id || '/' || turn AS citation, 'title ' || conv_id AS title, text AS content FROM conversations WHERE turn < 6)"
BATCH = """(SELECT conv_id AS conversation, turn AS local_id, CASE WHEN turn = 1 AND conv_id % 5 = 0 THEN 'new/' ELSE 'msg/' END || conv_id || '/' || turn AS citation, CASE WHEN conv_id % 7 = 0 THEN 'renamed ' ELSE 'title ' END || conv_id AS title, CASE WHEN turn = 2 AND conv_id % 3 = 0 THEN text || ' edited' ELSE text END AS content
 FROM conversations WHERE turn IN (1, 2, 6) AND conv_id % 2 = 1)"""
DELETED = "(SELECT 'msg/' || conv_id || '/' || turn AS citation FROM conversations WHERE turn = 3 AND conv_id % 4 < 2)"
OWNERS = "(SELECT 'msg/' || conv_id || '/' || turn AS citation, s AS source FROM conversations, (SELECT unnest(['here', 'there']) AS s) WHERE turn < 6 AND (s = 'here' OR conv_id % 4 = 0))"
DELTA = f"""t AS (SELECT * FROM {TARGET} x), b AS (SELECT * FROM {BATCH} x), del AS (SELECT * FROM {DELETED} x), own AS (SELECT * FROM {OWNERS} x),
 ch AS (SELECT b.*, CASE WHEN t.citation IS NULL THEN 'new' WHEN t.citation <> b.citation THEN 'renamed' ELSE 'changed' END AS change, t.citation AS old FROM b LEFT JOIN t ON t.conversation = b.conversation AND t.local_id = b.local_id WHERE t.citation IS NULL OR t.citation <> b.citation OR t.title <> b.title OR t.content <> b.content),
 gone AS (SELECT citation FROM del WHERE citation IN (SELECT citation FROM t) AND citation NOT IN (SELECT citation FROM b) AND citation NOT IN (SELECT citation FROM own WHERE source <> 'here') UNION SELECT old FROM ch WHERE change = 'renamed'),
 tn AS (SELECT conversation, first(title ORDER BY local_id DESC) AS title FROM b GROUP BY 1),
 fan AS (SELECT t.citation FROM t JOIN tn ON tn.conversation = t.conversation WHERE tn.title <> t.title AND t.citation NOT IN (SELECT citation FROM gone) AND NOT EXISTS (SELECT 1 FROM b WHERE b.conversation = t.conversation AND b.local_id = t.local_id)),
 aft AS (SELECT citation, source FROM own WHERE citation NOT IN (SELECT citation FROM gone) AND NOT (source = 'here' AND citation IN (SELECT citation FROM del)) UNION SELECT citation, 'here' FROM b),
 dirty AS (SELECT citation FROM ch UNION SELECT citation FROM gone UNION SELECT citation FROM fan),
 left_over AS (SELECT t.* FROM t WHERE citation NOT IN (SELECT citation FROM gone) AND NOT EXISTS (SELECT 1 FROM b WHERE b.conversation = t.conversation AND b.local_id = t.local_id))"""


def delta(spark, d):
    c = S.raw(spark, d, "conversations")
    cite = lambda head: F.concat(head, F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("citation")
    title = lambda head: F.concat(head, F.col("conv_id").cast("string")).alias("title")
    msg, keys = F.lit("msg/"), [F.col("conv_id").alias("conversation"), F.col("turn").alias("local_id")]
    target = c.filter("turn < 6").select(*keys, cite(msg), title(F.lit("title ")), F.col("text").alias("content"))
    b = c.filter("turn in (1, 2, 6) and conv_id % 2 = 1")
    head = F.when((F.col("turn") == 1) & (F.col("conv_id") % 5 == 0), "new/").otherwise("msg/")
    content = F.when((F.col("turn") == 2) & (F.col("conv_id") % 3 == 0), F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    batch = b.select(*keys, cite(head), title(F.when(F.col("conv_id") % 7 == 0, "renamed ").otherwise("title ")), content.alias("content"))
    deleted = c.filter("turn = 3 and conv_id % 4 < 2").select(cite(msg))
    owned = c.filter("turn < 6").select("conv_id", cite(msg))
    owners = owned.select("citation", F.lit("here").alias("source")).unionByName(owned.filter("conv_id % 4 = 0").select("citation", F.lit("there").alias("source")))
    return I.message_delta(target, owners, batch, deleted, "here"), (target, owners, batch, deleted)


@query("message_delta", f"WITH {DELTA} SELECT change, citation FROM ch UNION ALL SELECT 'tombstone', citation FROM gone UNION ALL SELECT 'fan_out', citation FROM fan UNION ALL SELECT 'dirty', citation FROM dirty UNION ALL SELECT 'owner ' || source, citation FROM aft")
def message_delta(spark, d):
    """All that a batch does: changes, renames, tombstones, titles taken over, dirty citations, owners."""
    p, _ = delta(spark, d)
    out = p["changes"].select("change", "citation")
    for name in ("tombstones", "fan_out", "dirty"):
        out = out.unionByName(p[name].select(F.lit({"tombstones": "tombstone"}.get(name, name)).alias("change"), "citation"))
    return out.unionByName(p["owners"].select(F.concat(F.lit("owner "), "source").alias("change"), "citation"))


@query("message_delta_result", f"WITH {DELTA} SELECT conversation, local_id, citation, CASE WHEN citation IN (SELECT citation FROM fan) THEN (SELECT title FROM tn WHERE tn.conversation = l.conversation) ELSE title END AS title, sha256(content) AS digest FROM left_over l UNION ALL SELECT conversation, local_id, citation, title, sha256(content) FROM b")
def message_delta_result(spark, d):
    return delta(spark, d)[0]["messages"].select("conversation", "local_id", "citation", "title", F.sha2("content", 256).alias("digest"))


@query("message_delta_again", "SELECT 0 AS changes, 0 AS tombstones, 0 AS fan_out")
def message_delta_again(spark, d):
    """The same batch over its own result: nothing changes."""
    first, (_, _, batch, deleted) = delta(spark, d)
    again = I.message_delta(first["messages"], first["owners"], batch, deleted, "here")
    counts = [again[k].agg(F.count("*").cast("int").alias(k)) for k in ("changes", "tombstones", "fan_out")]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))


@query("understanding_union", """SELECT coalesce(d.doc_id, p.page_id) AS doc_id, CASE WHEN p.page_id IS NULL OR length(trim(p.t)) = 0 THEN d.source ELSE p.t END AS text, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN d.doc_id IS NULL THEN [] ELSE ['doc/' || d.doc_id, 'src/' || d.source] END, CASE WHEN p.page_id IS NULL THEN [] ELSE ['doc/' || p.page_id, 'page/' || p.page_id] END))), ',') AS citations
 FROM documents d FULL JOIN (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ' ' ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS t FROM pages) p ON p.page_id = d.doc_id""")
def understanding_union(spark, d):
    """The new text stands unless it is blank; citations of both sides are kept."""
    doc, page = F.col("doc_id").cast("string"), F.col("page_id").cast("string")
    old = S.raw(spark, d, "documents").select("doc_id", F.col("source").alias("text"), F.array(F.concat(F.lit("doc/"), doc), F.concat(F.lit("src/"), "source")).alias("citations"))
    title = F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.regexp_extract("html", "<title>([^<]*)", 1))
    new = S.raw(spark, d, "pages").select(F.col("page_id").alias("doc_id"), title.alias("text"), F.array(F.concat(F.lit("doc/"), page), F.concat(F.lit("page/"), page)).alias("citations"))
    return I.union_merge(old, new, "doc_id", "text", "citations").withColumn("citations", F.concat_ws(",", "citations"))


@query("source_revision", """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 1 WHEN doc_id % 3 = 0 THEN doc_id % 4 + 1 ELSE doc_id % 4 END AS revision FROM documents""")
def source_revision(spark, d):
    """Only columns that the embedding depends on raise the revision; new rows begin at 1."""
    docs = S.raw(spark, d, "documents").select("doc_id", "text", "source", "n_chars")
    old = docs.filter("doc_id % 5 <> 4").withColumn("revision", (F.col("doc_id") % 4).cast("long"))
    new = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).withColumn("n_chars", F.lit(0))
    return I.revised(old, new, "doc_id", ["text", "source"]).select("doc_id", "revision")


@query("queue_claims", """WITH q AS (SELECT user_id AS entity, ts AS due, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 2 DAY END AS lease_until, event_id AS generation FROM events WHERE event_type = 'error'),
 f AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY due, generation) AS n FROM q WHERE due <= TIMESTAMP '2024-01-20 00:00:00' AND (lease_until IS NULL OR lease_until <= TIMESTAMP '2024-01-20 00:00:00'))
 SELECT entity, due, TIMESTAMP '2024-01-20 00:05:00' AS lease_until, generation + 1 AS generation FROM f WHERE n = 1 ORDER BY due, entity LIMIT 20""")
def queue_claims(spark, d):
    e = S.raw(spark, d, "events").filter("event_type = 'error'")
    lease = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 2 days"))
    q = e.select(F.col("user_id").alias("entity"), F.col("ts").alias("due"), lease.alias("lease_until"), F.col("event_id").alias("generation"))
    return I.claimed(q, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 300, 20)


CHUNKS = """(SELECT doc_id, chunk_index, substring(t, chunk_index * 780 + 1, 900) AS content, 'doc/' || doc_id AS parent FROM (SELECT doc_id, t, unnest(range(0, greatest(CAST(ceil((length(t) - 120) / 780.0) AS BIGINT), 1))) AS chunk_index FROM (SELECT doc_id, {text} AS t FROM documents) x) c)"""


@query("rebuilt_chunks", f"SELECT parent, chunk_index, sha256(content) AS digest FROM {CHUNKS.format(text='text')} a WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT parent, chunk_index, sha256(content) FROM {CHUNKS.format(text="'new ' || text")} b WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id % 2 = 0")
def rebuilt_chunks(spark, d):
    """Chunks of some documents are made anew (with a word before), those that are gone lose theirs, all others stay."""

    def chunks(text):
        docs = S.raw(spark, d, "documents").select("doc_id", text.alias("text"))
        c = L.fixed_chunks(docs, "doc_id", "text")
        return c.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("parent"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk").alias("content"), "doc_id")

    parents = S.raw(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("parent"))
    out = I.rebuilt(chunks(F.col("text")), chunks(F.concat(F.lit("new "), "text")).filter("doc_id % 2 = 0"), parents)
    return out.select("parent", "chunk_index", F.sha2("content", 256).alias("digest"))


@query("vector_documents", "SELECT citation, digest FROM (SELECT 'msg/' || conv_id || '/' || turn AS citation, sha256('by ' || role || chr(10) || text) AS digest FROM conversations) m WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'xx')")
def vector_documents(spark, d):
    """Chunks where there are any, here of a language that there is none of, else messages."""
    c = S.raw(spark, d, "documents").filter("lang = 'xx'").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("citation"), F.col("lang").alias("actor"), F.col("text").alias("content"))
    m = S.messages(spark, d).select("citation", F.col("sender").alias("actor"), "content")
    return E.vector_documents(c, m).select("citation", F.sha2("vector_text", 256).alias("digest"))


@query("purge_with_audit", """WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey <> 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT 1 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
 r AS (SELECT 'customer' AS step, (SELECT count(*) FROM customer) - (SELECT count(*) FROM c) AS removed UNION ALL SELECT 'orders', (SELECT count(*) FROM orders) - (SELECT count(*) FROM o) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM l))
 SELECT * FROM r UNION ALL SELECT 'audit', CAST(sum(removed) AS BIGINT) FROM r""")
def purge_with_audit(spark, d):
    """Three tables in the order of their dependency, and a row that sums up what went."""
    c = S.raw(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = S.raw(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = S.raw(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    out = S.raw(spark, d, "nation").filter("n_nationkey = 3").select("n_nationkey")
    counts = E.purged({"customer": c, "orders": o, "lineitem": li}, out, {"customer": "c_nationkey"}, {"orders": ("customer", "o_custkey"), "lineitem": ("orders", "o_orderkey")})[1].withColumnRenamed("table", "step")
    return counts.unionByName(counts.agg(F.lit("audit").alias("step"), F.sum("removed").alias("removed")))


@query("logical_keys", """SELECT kind, count(*) AS rows, count(DISTINCT k) AS events FROM (
 SELECT 'message' AS kind, concat_ws('|', 'group', lower(source), lower(lang), CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'image' END, n_chars // 100, doc_id % 3, doc_id % 50) AS k FROM documents
 UNION ALL SELECT 'moment', concat_ws('|', lower(trim(regexp_replace(substring(text, 1, 20), '\\s+', ' ', 'g'))), source, n_chars // 100) FROM documents
 UNION ALL SELECT 'interaction', concat_ws('|', event_type, user_id % 7, user_id, date_trunc('hour', ts)) FROM events
 UNION ALL SELECT 'media', concat_ws('|', lower(trim(regexp_replace(substring(text, 1, 20), '\\s+', ' ', 'g'))), 'image', source, n_chars // 100, 'image-' || doc_id % 2) FROM documents) x GROUP BY kind""")
def logical_keys(spark, d):
    """Rows and distinct events of each kind of evidence."""
    docs, n = S.raw(spark, d, "documents"), F.floor(F.col("n_chars") / 100)
    i = F.col("doc_id")
    message = docs.select(F.lit("group").alias("conversation_type"), F.upper("source").alias("conversation_title"), F.concat(F.lit(" "), "lang").alias("sender_name"), F.when(i % 2 == 0, "text").otherwise("image").alias("content_kind"), n.alias("at"), (i % 3).alias("shard"), (i % 50).alias("local_id"))
    moment = docs.select(F.substring("text", 1, 20).alias("text"), F.col("source").alias("author"), n.alias("at"), F.lit("IMAGE").alias("modality"), E.media_position(F.concat(F.lit("doc/1#x#image-"), (i % 2).cast("string"))).alias("position"))
    e = S.raw(spark, d, "events").select(F.col("event_type").alias("interaction_type"), (F.col("user_id") % 7).alias("author"), F.col("user_id").alias("actor"), F.date_trunc("hour", "ts").alias("at"))
    out = None
    for kind, rows in (("message", message), ("moment", moment), ("interaction", e), ("media", moment)):
        part = rows.select(F.lit(kind).alias("kind"), E.logical_key_of(kind).alias("k"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(F.count("*").alias("rows"), F.countDistinct("k").alias("events"))


@query("kind_backfill", """SELECT page_id, kind FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'text' WHEN page_id % 4 = 1 THEN NULL ELSE k END AS old, k AS kind FROM (SELECT page_id, CASE WHEN contains(lower(html), '<video') THEN 'video' WHEN contains(lower(html), '<img') THEN 'image' WHEN contains(lower(html), '<table') THEN 'table' ELSE 'text' END AS k FROM pages) p) x WHERE old IS DISTINCT FROM kind""")
def kind_backfill(spark, d):
    """Kinds worked out anew; the rows whose stored kind is another, or none, are what is written."""
    from ..functions.text import first_match
    from ..operators.joins import changed_columns

    h = F.lower("html")
    kind = first_match([(h.contains("<video"), "video"), (h.contains("<img"), "image"), (h.contains("<table"), "table")], "text")
    fresh = S.raw(spark, d, "pages").select("page_id", kind.alias("kind"))
    stored = fresh.withColumn("kind", F.when(F.col("page_id") % 4 == 0, "text").when(F.col("page_id") % 4 == 1, None).otherwise(F.col("kind")))
    return changed_columns(fresh, stored, ["page_id"], ["kind"]).select("page_id", "kind")


@query("snapshot_listing", """WITH v AS (SELECT user_id AS entity, event_id, ts, event_type AS content, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 k AS (SELECT *, lag(content) OVER (PARTITION BY entity ORDER BY rn) AS before FROM v), n AS (SELECT entity, ts, content, row_number() OVER (PARTITION BY entity ORDER BY rn) AS version FROM k WHERE before IS DISTINCT FROM content)
 SELECT entity, max(version) AS versions, max(ts) AS changed_at, first(content ORDER BY version DESC) AS content, CASE WHEN max(version) = 1 THEN 'new' WHEN max(ts) >= TIMESTAMP '2024-01-25 00:00:00' THEN 'fresh' ELSE 'stale' END AS status FROM n GROUP BY entity""")
def snapshot_listing(spark, d):
    """Versions of each entity's snapshot, of which equal ones in a row are one, and how it stands."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("ts", "event_id")
    e = S.raw(spark, d, "events").select(F.col("user_id").alias("entity"), "ts", "event_id", F.col("event_type").alias("content"))
    fresh = e.withColumn("before", F.lag("content").over(w)).filter(~F.col("content").eqNullSafe(F.col("before")))
    g = fresh.groupBy("entity").agg(F.count("*").alias("versions"), F.max("ts").alias("changed_at"), F.max_by("content", F.struct("ts", "event_id")).alias("content"))
    since = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return g.withColumn("status", F.when(F.col("versions") == 1, "new").when(F.col("changed_at") >= since, "fresh").otherwise("stale"))
