"""Queries over citations, media, claims and schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import filters as P
from ..operators import lexical as L
from ..operators import windows as W
from ..sources import tables as S
from .registry import query

CHUNKS = """(SELECT doc_id, chunk_index, substring(text, chunk_index * 780 + 1, 900) AS content, doc_id || '#chunk-' || chunk_index AS citation, CAST(doc_id AS VARCHAR) AS parent FROM
 (SELECT *, unnest(range(0, greatest(CAST(ceil((length(text) - 120) / 780.0) AS BIGINT), 1))) AS chunk_index FROM documents) c)"""


def chunks(spark, d):
    c = L.fixed_chunks(S.raw(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk").alias("content"), "citation", F.col("doc_id").cast("string").alias("parent"))


UNIFIED = f"""(SELECT citation, actor, family FROM (SELECT *, row_number() OVER (PARTITION BY citation ORDER BY pr) AS n FROM (
 SELECT 'msg/' || conv_id || '/' || turn AS citation, role AS actor, 'message' AS family, 0 AS pr FROM conversations UNION ALL SELECT 'doc/' || doc_id, source, 'document', 1 FROM documents UNION ALL SELECT 'page/' || page_id, url, 'page', 2 FROM pages UNION ALL SELECT 'doc/' || doc_id, 'label', 'label', 3 FROM labels) u) t WHERE n = 1)"""


def families(spark, d):
    """For each prefix of citations the families behind it: name, priority and rows, cut to a list of keys where one is given."""
    cite = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string")).alias("citation")

    def message(keys=None):
        m = S.messages(spark, d)
        if keys is not None:
            m = m.filter(F.col("conversation_id").isin([k[0] for k in keys]) & F.col("local_id").isin([k[-1] for k in keys]))
        return "message", 0, m.select("citation", F.col("sender").alias("actor"), "content")

    def of(family, priority, prefix, name, key, actor, content):
        def rows(keys=None):
            t = S.raw(spark, d, name)
            t = t if keys is None else t.filter(F.col(key).isin([k[0] for k in keys]))
            return family, priority, t.select(cite(prefix, key), actor.alias("actor"), content.alias("content"))

        return rows

    document = of("document", 1, "doc", "documents", "doc_id", F.col("source"), F.col("text"))
    page = of("page", 2, "page", "pages", "page_id", F.col("url"), F.col("html"))
    label = of("label", 3, "doc", "labels", "doc_id", F.lit("label"), F.lit(None).cast("string"))
    return {"msg": [message], "doc": [document, label], "page": [page]}


def relation(spark, d):
    return E.unified([of() for makers in families(spark, d).values() for of in makers])


@query("unified_evidence", f"SELECT family, count(*) AS n FROM {UNIFIED} u GROUP BY family")
def unified_evidence(spark, d):
    return relation(spark, d).groupBy("family").agg(F.count("*").alias("n"))


@query("evidence_lookup", f"SELECT citation, actor, family FROM {UNIFIED} u WHERE citation IN ('doc/1', 'page/2', 'msg/3/1', 'doc/none')")
def evidence_lookup(spark, d):
    return E.lookup(families(spark, d), ["doc/1", "page/2", "msg/3/1", "doc/none"]).select("citation", "actor", "family")


@query("dirty_vector_documents", f"SELECT DISTINCT citation FROM {CHUNKS} c WHERE parent IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) OR citation IN (SELECT doc_id || '#chunk-0' FROM labels WHERE quality = 0)")
def dirty_vector_documents(spark, d):
    lab = S.raw(spark, d, "labels")
    key = F.col("doc_id").cast("string")
    dirty = lab.filter("toxic = 1").select(key.alias("citation")).unionByName(lab.filter("quality = 0").select(F.concat(key, F.lit("#chunk-0")).alias("citation"))).distinct()
    return E.dirty_documents(chunks(spark, d), dirty).select("citation")


@query("media_hints", "SELECT DISTINCT 'doc/' || l.doc_id || '#chunk-0' AS citation, 'doc/' || l.doc_id || '#image-' || p.page_id AS media FROM labels l JOIN pages p ON p.page_id = l.doc_id WHERE l.quality = 1")
def media_hints(spark, d):
    key = F.col("doc_id").cast("string")
    cites = S.raw(spark, d, "labels").filter("quality = 1").select(F.concat(F.lit("doc/"), key, F.lit("#chunk-0")).alias("citation"))
    p = F.col("page_id").cast("string")
    return E.media_hints(cites, S.raw(spark, d, "pages").select(F.concat(F.lit("doc/"), p, F.lit("#image-"), p).alias("citation")))


LIVE = "(SELECT conv_id * 1000 + turn + CASE WHEN turn % 3 = 2 THEN 500 ELSE 0 END AS position, CASE WHEN turn % 2 = 0 THEN 'text' ELSE 'image' END AS kind, CASE WHEN turn % 5 = 4 THEN 'other' ELSE ' ' || text || ' ' END AS text, 'live/' || conv_id || '/' || turn AS citation FROM conversations WHERE conv_id % 2 = 0)"
HISTORY = "(SELECT conv_id * 1000 + turn AS position, CASE WHEN turn % 4 = 1 THEN 'image' ELSE 'text' END AS kind, text, CASE WHEN role = 'user' THEN 'incoming' ELSE 'outgoing' END AS direction, 'msg/' || conv_id || '/' || turn AS citation FROM conversations)"


@query("merge_live", f"""SELECT position, kind, citation, FALSE AS live FROM {HISTORY} h UNION ALL SELECT position, kind, citation, TRUE FROM {LIVE} l WHERE NOT EXISTS (SELECT 1 FROM {HISTORY} h WHERE h.position = l.position AND h.direction = 'incoming' AND ((l.kind <> 'text' AND h.kind = l.kind) OR (l.kind = 'text' AND trim(h.text) = trim(l.text))))""")
def merge_live(spark, d):
    c = S.raw(spark, d, "conversations")
    turn, place = F.col("turn"), F.col("conv_id") * 1000 + F.col("turn")
    cite = lambda kind: F.concat_ws("/", F.lit(kind), F.col("conv_id").cast("string"), turn.cast("string")).alias("citation")
    h = c.select(place.alias("position"), F.when(turn % 4 == 1, "image").otherwise("text").alias("kind"), "text", F.when(F.col("role") == "user", "incoming").otherwise("outgoing").alias("direction"), cite("msg"))
    text = F.when(turn % 5 == 4, "other").otherwise(F.concat(F.lit(" "), "text", F.lit(" ")))
    live = c.filter("conv_id % 2 = 0").select((place + F.when(turn % 3 == 2, 500).otherwise(0)).alias("position"), F.when(turn % 2 == 0, "text").otherwise("image").alias("kind"), text.alias("text"), cite("live"))
    return E.merge_live(h, live).select("position", "kind", "citation", "live")


@query("purge_cascade", """WITH o AS (SELECT * FROM orders WHERE o_custkey % 10 <> 3), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
 SELECT 'orders' AS "table", (SELECT count(*) FROM orders) - (SELECT count(*) FROM o) AS removed UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM l)""")
def purge_cascade(spark, d):
    orders = S.raw(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    out = orders.select("o_custkey").distinct().filter("o_custkey % 10 = 3")
    return E.purged({"orders": orders, "lineitem": S.raw(spark, d, "lineitem").select("l_orderkey")}, out, {"orders": "o_custkey"}, {"lineitem": ("orders", "l_orderkey")})[1]


@query("understanding_merge", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE source END = text AS replaced FROM documents")
def understanding_merge(spark, d):
    new = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.lit(" "))
    return S.raw(spark, d, "documents").select("doc_id", (E.keep_unless_new(F.col("source"), new) == F.col("text")).alias("replaced"))


@query("logical_dedupe", "SELECT sha256(lower(trim(role)) || chr(31) || lower(trim(text))) AS logical_key, count(*) AS copies, min(conv_id * 1000 + turn) AS first_row FROM conversations GROUP BY 1")
def logical_dedupe(spark, d):
    c = S.raw(spark, d, "conversations").select(E.logical_key(F.col("role"), F.col("text")).alias("logical_key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row"))
    return c.groupBy("logical_key").agg(F.count("*").alias("copies"), F.min("row").alias("first_row"))


@query("first_come_collect", "SELECT doc_id FROM (SELECT doc_id, min(q) AS q FROM (SELECT doc_id, 0 AS q FROM documents WHERE contains(lower(text), 'idiot') UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT doc_id, 2 FROM documents WHERE lang = 'es') u GROUP BY doc_id) t ORDER BY q, doc_id LIMIT 50")
def first_come_collect(spark, d):
    docs = S.raw(spark, d, "documents")
    qs = [docs.filter(T.contains_fold(F.col("text"), "idiot")), docs.filter(T.contains_fold(F.col("text"), "license")), docs.filter("lang = 'es'")]
    return E.first_come([q.select("doc_id") for q in qs], "doc_id", "doc_id", 50)


@query("packed_kind", "SELECT event_id, CASE (event_id * 4294967296 + event_id % 5) & 4294967295 WHEN 1 THEN 'text' WHEN 3 THEN 'image' WHEN 4 THEN 'voice' ELSE 'unknown' END AS kind FROM events")
def packed_kind(spark, d):
    packed = F.col("event_id") * 4294967296 + F.col("event_id") % 5
    return S.raw(spark, d, "events").select("event_id", E.kind_of_packed(packed, {1: "text", 3: "image", 4: "voice"}).alias("kind"))


@query("display_projection", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN '[image]' ELSE substring(html, 1, 200) END AS shown FROM pages")
def display_projection(spark, d):
    kind = F.when(F.col("page_id") % 3 == 0, "text").when(F.col("page_id") % 3 == 1, "image").otherwise("appmsg")
    return S.raw(spark, d, "pages").select("page_id", E.display_content(kind, F.col("html"), {"image": "[image]"}).alias("shown"))


@query("episode_tail", """WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS last FROM conversations), c AS (SELECT * FROM n WHERE (conv_id % 2 = 0 AND rn > last - 2) OR (conv_id % 2 = 1 AND rn IN (1, last))),
 g AS (SELECT conv_id, min(rn) AS first, count(*) AS rows, max(last) AS last FROM c GROUP BY conv_id)
 SELECT conv_id, last - first + 1 = rows AND conv_id % 7 <> 0 AS tail_only, CASE WHEN last - first + 1 = rows AND conv_id % 7 <> 0 THEN CAST(floor(greatest(first - 4, 0) / 3.0) * 3 AS BIGINT) ELSE 0 END AS from_row FROM g""")
def episode_tail(spark, d):
    c = S.raw(spark, d, "conversations").select("conv_id", "turn")
    n = W.resequenced(c, ["conv_id"], F.asc("turn"), into="n")
    last = n.groupBy("conv_id").agg(F.max("n").alias("last"))
    j = n.join(last, "conv_id")
    changed = j.filter("(conv_id % 2 = 0 and n > last - 2) or (conv_id % 2 = 1 and n in (1, last))").select("conv_id", "n")
    return E.episode_tail(changed, n, "conv_id", c.select("conv_id").filter("conv_id % 7 = 0"))


@query("pending_anti_count", "SELECT d.lang, count(*) AS pending FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars > 500 GROUP BY d.lang")
def pending_anti_count(spark, d):
    docs = S.raw(spark, d, "documents").filter("n_chars > 500").select("doc_id", "lang")
    return docs.join(S.raw(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("pending"))


@query("interaction_scope_left", "SELECT e.event_id, c.c_name IS NOT NULL AS known FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'signup' OR c.c_mktsegment = 'BUILDING'")
def interaction_scope_left(spark, d):
    c = S.raw(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    j = S.raw(spark, d, "events").select("event_id", "user_id", "event_type").join(c, "user_id", "left")
    return j.filter("event_type = 'signup' or c_mktsegment = 'BUILDING'").select("event_id", F.col("c_name").isNotNull().alias("known"))


@query("impacted_subscriptions", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def impacted_subscriptions(spark, d):
    nations = S.raw(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    open_ = S.raw(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return S.raw(spark, d, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey", "left_semi").join(open_, "c_custkey", "left_semi").select("c_custkey")


@query("claim_due", "SELECT user_id, due FROM (SELECT user_id, min(ts) AS due FROM events WHERE event_type = 'error' GROUP BY user_id) q WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ORDER BY due, user_id LIMIT 1")
def claim_due(spark, d):
    q = S.raw(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("due"))
    ok = S.raw(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return q.join(ok, "user_id", "left_semi").orderBy("due", "user_id").limit(1)


@query("round_ready", "SELECT event_id, value > 0 AND ts >= greatest(TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-12 00:00:00') AS ready FROM events")
def round_ready(spark, d):
    at = [F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10 00:00:00", "2024-01-12 00:00:00")]
    return S.raw(spark, d, "events").select("event_id", ((F.col("value") > 0) & (F.col("ts") >= F.greatest(*at))).alias("ready"))


@query("quiet_window", "SELECT event_id, least(1800, 300 + 60 * least(event_id % 15, 10) + CASE WHEN event_type = 'purchase' THEN 600 ELSE 0 END) AS seconds FROM events")
def quiet_window(spark, d):
    n = F.least(F.col("event_id") % 15, F.lit(10))
    return S.raw(spark, d, "events").select("event_id", F.least(F.lit(1800), 300 + 60 * n + F.when(F.col("event_type") == "purchase", 600).otherwise(0)).alias("seconds"))


@query("cost_estimate", "SELECT lang, CAST(sum(ceil(n_chars / 4.0)) AS BIGINT) AS tokens, round(CAST(sum(ceil(n_chars / 4.0)) AS BIGINT) * 0.002 / 1000, 6) AS cost FROM documents GROUP BY lang")
def cost_estimate(spark, d):
    tokens = F.sum(F.ceil(F.col("n_chars") / 4))
    return S.raw(spark, d, "documents").groupBy("lang").agg(tokens.cast("long").alias("tokens"), F.round(tokens * 0.002 / 1000, 6).alias("cost"))


#: Millionths for a unit of each kind of use, from a time on; `error` has no price.
PRICES = [("view", "2024-01-01", 3), ("view", "2024-01-12", 5), ("click", "2024-01-01", 7), ("signup", "2024-01-05", 11), ("purchase", "2024-01-01", 20), ("purchase", "2024-01-20", 15)]
_PRICES = ", ".join(f"('{k}', TIMESTAMP '{t} 00:00:00', {p})" for k, t, p in PRICES)


@query("cost_by_model", f"""WITH p AS (SELECT *, lead(since) OVER (PARTITION BY model ORDER BY since) AS until FROM (VALUES {_PRICES}) v(model, since, price)),
 u AS (SELECT event_type AS model, ts, CAST(round(coalesce(value, 0)) AS BIGINT) AS tokens FROM events)
 SELECT u.model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE price IS NULL) AS unpriced, CAST(coalesce(sum(tokens * price), 0) AS BIGINT) AS cost FROM u LEFT JOIN p ON p.model = u.model AND u.ts >= p.since AND (p.until IS NULL OR u.ts < p.until) GROUP BY 1""")
def cost_by_model(spark, d):
    """Use by kind, each at the price of its kind and time."""
    e = S.raw(spark, d, "events").select(F.col("event_type").alias("model"), F.col("ts").alias("at"), F.round(F.coalesce("value", F.lit(0.0))).cast("long").alias("tokens"))
    return E.priced(e, PRICES)


@query("dirty_parents", f"SELECT parent, count(*) AS chunks, max(chunk_index) AS last_chunk FROM {CHUNKS} c WHERE contains(lower(content), 'license') GROUP BY parent")
def dirty_parents(spark, d):
    c = chunks(spark, d).filter(T.contains_fold(F.col("content"), "license"))
    return c.groupBy("parent").agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last_chunk"))


@query("chunk_rebuild_counts", f"SELECT count(DISTINCT parent) AS parents, count(*) AS chunks FROM {CHUNKS} c")
def chunk_rebuild_counts(spark, d):
    return chunks(spark, d).agg(F.countDistinct("parent").alias("parents"), F.count("*").alias("chunks"))


@query("message_evidence", "SELECT conv_id, turn, CASE WHEN length(text) > 240 THEN rtrim(substring(text, 1, 239)) || '…' ELSE text END AS summary FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B\\x{00A0}\\x{3000}]+', ' ', 'g')) AS text FROM conversations WHERE NOT regexp_matches(text, '^\\[.*\\]$')) c")
def message_evidence(spark, d):
    c = S.raw(spark, d, "conversations").filter(~F.col("text").rlike(r"^\[.*\]$"))
    return c.select("conv_id", "turn", T.bounded(F.col("text"), 240).alias("summary"))


@query("scoped_messages", "SELECT conv_id, turn FROM conversations WHERE conv_id < 20 UNION ALL SELECT conv_id, turn FROM conversations WHERE conv_id >= 20 AND role = 'user'")
def scoped_messages(spark, d):
    c = S.raw(spark, d, "conversations").select("conv_id", "turn", "role")
    return c.filter("conv_id < 20").drop("role").unionByName(c.filter("conv_id >= 20 and role = 'user'").drop("role"))


@query("scoped_person_messages", """WITH s AS (SELECT conv_id, turn, role, text, 'private' AS scope FROM conversations WHERE conv_id < 20 UNION ALL SELECT conv_id, turn, role, text, 'group' FROM conversations WHERE conv_id >= 20 AND role = 'user'),
 k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) ORDER BY turn) AS n FROM s)
 SELECT scope, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM k WHERE n = 1""")
def scoped_person_messages(spark, d):
    """A person's private conversations whole, and what they said in groups; a message said again in a conversation counts once, and the newest comes first."""
    c = S.raw(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    scoped = c.filter("conv_id < 20").withColumn("scope", F.lit("private")).unionByName(c.filter("conv_id >= 20 and role = 'user'").withColumn("scope", F.lit("group")))
    said = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    once = scoped.groupBy("scope", "conv_id", "role", said.alias("said")).agg(F.min("turn").alias("turn"))  # no text is sorted
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return once.select("scope", "conv_id", "turn", place.cast("long").alias("place"))


@query("observation_lifecycle", "SELECT event_id FROM events WHERE event_type <> 'error' AND event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_id % 4 = 0)")
def observation_lifecycle(spark, d):
    e = S.raw(spark, d, "events").select("event_id", "event_type")
    superseded = e.filter("event_id % 4 = 0").select((F.col("event_id") - 1).alias("event_id"))
    return e.filter("event_type <> 'error'").join(superseded, "event_id", "left_anti").select("event_id")


@query("file_candidates", "SELECT event_id FROM events WHERE event_type IN ('view', 'purchase') AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00' AND (contains(lower(props), '7') OR contains(CAST(event_id AS VARCHAR), '7'))")
def file_candidates(spark, d):
    """A contact's name in the title or id, of kinds that carry files, within a time range."""
    named = T.contains_fold(F.col("props"), "7") | F.col("event_id").cast("string").contains("7")
    within = P.message_filter({"since": "2024-01-03 00:00:00", "until": "2024-01-25 00:00:00"}, time="ts")
    return S.raw(spark, d, "events").filter(P.all_of([F.col("event_type").isin("view", "purchase"), within, named])).select("event_id")


@query("content_identity", "SELECT count(*) AS rows, bit_xor(h) AS xor, CAST(sum(h) AS VARCHAR) AS sum FROM (SELECT CAST('0x' || substring(md5(doc_id || chr(31) || coalesce(text, chr(0))), 1, 15) AS BIGINT) AS h FROM documents) d")
def content_identity(spark, d):
    return E.content_digest(S.raw(spark, d, "documents"), "doc_id", "text")


@query("contact_identifiers", "SELECT 'c' || c_custkey AS entity_id, 'segment' AS kind, c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL UNION ALL SELECT 'c' || c_custkey, 'name', c_name FROM customer")
def contact_identifiers(spark, d):
    from ..sources.people import identifiers

    return identifiers(S.raw(spark, d, "customer"), "c", "c_custkey", {"segment": "c_mktsegment", "name": "c_name"})


@query("moments_keep_orphans", "SELECT e.event_id, c.c_custkey IS NULL AS orphan FROM events e LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = e.user_id")
def moments_keep_orphans(spark, d):
    from ..sources.people import with_orphans

    items = S.raw(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return with_orphans(S.raw(spark, d, "events").select("event_id", "user_id"), items, "user_id").select("event_id", "orphan")
