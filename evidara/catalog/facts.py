"""Queries over the star schema, embeddings, labels and the benchmark: joins, sets, vectors,
incremental operators, entities and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..operators import joins as J
from ..operators import ranking as R
from ..operators.windows import first_by
from ..functions.vectors import cosine
from ..sources import tables as S
from .registry import query


def money(c):
    return F.col(c).cast("decimal(18,2)")


@query("valid_transcript_semi", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND p.p_size < 10)")
def valid_transcript_semi(spark, d):
    li = S.raw(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    part = S.raw(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    keys = li.join(part, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.raw(spark, d, "orders").select("o_orderkey").join(keys, "o_orderkey", "left_semi")


@query("account_summary_left", """WITH o AS (SELECT o_custkey, count(*) AS orders, max(o_orderdate) AS last_order FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
 SELECT c_custkey, coalesce(orders, 0) AS orders, last_order, coalesce(lines, 0) AS lines FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey""")
def account_summary_left(spark, d):
    orders = S.raw(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    lines = S.raw(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = orders.join(lines, "o_orderkey", "left").groupBy("c_custkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("last_order"), F.sum("n").alias("lines"))
    return S.raw(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "last_order", F.coalesce("lines", F.lit(0)).alias("lines"))


BATCH = "(SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN 'edited' ELSE event_type END AS event_type, value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id + 10000000, user_id, event_type, value FROM events WHERE event_id % 50 = 1)"


def batch(spark, d):
    e = S.raw(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    edited = e.filter("event_id % 3 = 0").withColumn("event_type", F.when(F.col("event_id") % 7 == 0, "edited").otherwise(F.col("event_type")))
    return e, edited.unionByName(e.filter("event_id % 50 = 1").withColumn("event_id", F.col("event_id") + 10_000_000))


@query("changed_rows", f"SELECT b.event_id, CASE WHEN e.event_id IS NULL THEN 'new' ELSE 'changed' END AS change FROM {BATCH} b LEFT JOIN events e ON b.event_id = e.event_id WHERE e.event_id IS NULL OR b.user_id IS DISTINCT FROM e.user_id OR b.event_type IS DISTINCT FROM e.event_type OR b.value IS DISTINCT FROM e.value")
def changed_rows(spark, d):
    target, new = batch(spark, d)
    return I.delta(target, new, ["event_id"]).select("event_id", "change")


@query("delta_upsert", f"SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT * FROM {BATCH} b UNION ALL SELECT event_id, user_id, event_type, value FROM events WHERE event_id NOT IN (SELECT event_id FROM {BATCH} b)) u GROUP BY event_type")
def delta_upsert(spark, d):
    target, new = batch(spark, d)
    return I.upsert(target, new, ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("delta_idempotent", "SELECT CAST(0 AS BIGINT) AS changed")
def delta_idempotent(spark, d):
    target, new = batch(spark, d)
    return I.delta(I.upsert(target, new, ["event_id"]), new, ["event_id"]).agg(F.count("*").alias("changed"))


@query("batch_last_wins", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def batch_last_wins(spark, d):
    return I.last_wins(S.raw(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.col("event_id"))


@query("tombstones", """WITH b AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00'), a AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'),
 g AS (SELECT user_id FROM b WHERE user_id NOT IN (SELECT user_id FROM a) UNION SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0)
 SELECT user_id FROM g WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-25 00:00:00')""")
def tombstones(spark, d):
    e = S.raw(spark, d, "events").select("user_id", "ts", "event_type")
    at = lambda t: F.col("ts") >= F.lit(t).cast("timestamp_ntz")
    present = e.filter(at("2024-01-25 00:00:00") & (F.col("event_type") == "error"))
    return I.tombstones(e.limit(0), e.filter("user_id % 10 = 0"), e.filter(~at("2024-01-10 00:00:00")), e.filter(at("2024-01-29 00:00:00")), present, "user_id")


@query("owner_release", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < DATE '1998-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01')")
def owner_release(spark, d):
    o = S.raw(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    old, new = o.filter("day < date '1998-01-01'"), o.filter("day >= date '1998-01-01'")
    return old.select("o_custkey").distinct().join(new.select("o_custkey"), "o_custkey", "left_anti")


@query("waterline_merge", "SELECT user_id, max(event_id) AS max_local, max(ts) AS max_time FROM events GROUP BY user_id")
def waterline_merge(spark, d):
    from ..sources.readers import waterlines

    e = S.raw(spark, d, "events")
    parts = [waterlines(e.filter(f"event_id % 2 = {k}"), ["user_id"], "event_id", "ts") for k in (0, 1)]
    return I.merge_marks(*parts, ["user_id"], ["max_local", "max_time"])


@query("dirty_batch_cas", "SELECT user_id, version FROM (SELECT user_id, max(ts) AS version FROM events GROUP BY user_id) q WHERE (user_id, version) NOT IN (SELECT user_id, max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-29 00:00:00' GROUP BY user_id)")
def dirty_batch_cas(spark, d):
    e = S.raw(spark, d, "events").select("user_id", "ts")
    queue = e.groupBy("user_id").agg(F.max("ts").alias("version"))
    done = e.filter("ts < timestamp_ntz '2024-01-29 00:00:00'").groupBy("user_id").agg(F.max("ts").alias("version"))
    return I.clear_processed(queue, done, "user_id", "version")


LEDGER = "(SELECT doc_id AS key, sha256(text) AS content_hash FROM documents WHERE doc_id % 10 <> 3)"
UPSERTS = "(SELECT doc_id AS key, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 2 = 0 OR doc_id % 10 = 3)"


def ledgers(spark, d):
    docs = S.raw(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    ledger = docs.filter("key % 10 <> 3").select("key", F.sha2("text", 256).alias("content_hash"))
    changed = F.when(F.col("key") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return ledger, docs.filter("key % 2 = 0 or key % 10 = 3").select("key", F.sha2(changed, 256).alias("content_hash")), docs.filter("key % 25 = 1").select("key")


@query("ledger_delta_counts", f"SELECT count(*) FILTER (WHERE l.key IS NULL AND u.key IS NOT NULL) AS inserted, count(*) FILTER (WHERE l.content_hash <> u.content_hash) AS changed, count(*) FILTER (WHERE l.content_hash = u.content_hash) AS unchanged, count(*) FILTER (WHERE l.key % 25 = 1) AS removed FROM {LEDGER} l FULL JOIN {UPSERTS} u ON l.key = u.key")
def ledger_delta_counts(spark, d):
    return I.ledger_counts(*ledgers(spark, d), "key")


@query("changed_only_embed", f"SELECT u.key FROM {UPSERTS} u LEFT JOIN {LEDGER} l ON l.key = u.key WHERE l.content_hash IS DISTINCT FROM u.content_hash")
def changed_only_embed(spark, d):
    ledger, ups, _ = ledgers(spark, d)
    return I.delta(ledger, ups, ["key"]).select("key")


@query("stale_after_scan", f"SELECT key FROM {LEDGER} l WHERE key NOT IN (SELECT key FROM {UPSERTS} u)")
def stale_after_scan(spark, d):
    ledger, ups, _ = ledgers(spark, d)
    return ledger.select("key").join(ups.select("key"), "key", "left_anti")


@query("snapshot_versions", f"SELECT u.key, CASE WHEN l.key IS NULL THEN 1 ELSE 2 END::BIGINT AS version FROM {UPSERTS} u LEFT JOIN {LEDGER} l ON l.key = u.key WHERE l.content_hash IS DISTINCT FROM u.content_hash UNION ALL SELECT key, 1 FROM {LEDGER} l")
def snapshot_versions(spark, d):
    ledger, ups, _ = ledgers(spark, d)
    return I.next_version(ledger.withColumn("version", F.lit(1).cast("long")), ups, "key").select("key", "version")


@query("set_diff_both_ways", "SELECT o_custkey, 'added' AS change FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1995-01-01') a UNION ALL SELECT o_custkey, 'removed' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < DATE '1995-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1997-01-01') r")
def set_diff_both_ways(spark, d):
    o = S.raw(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return I.set_difference(o.filter("day < date '1995-01-01'").select("o_custkey").distinct(), o.filter("day >= date '1997-01-01'").select("o_custkey").distinct(), "o_custkey")


@query("intersect_sets", "SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def intersect_sets(spark, d):
    return S.raw(spark, d, "labels").filter("toxic = 1").select("doc_id").intersect(S.raw(spark, d, "documents").filter("lang = 'en'").select("doc_id"))


@query("union_scopes", "SELECT conv_id, turn FROM conversations WHERE role = 'user' UNION SELECT conv_id, turn FROM conversations WHERE turn = 0")
def union_scopes(spark, d):
    c = S.raw(spark, d, "conversations")
    return c.filter("role = 'user'").select("conv_id", "turn").union(c.filter("turn = 0").select("conv_id", "turn")).distinct()


@query("stale_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def stale_anti(spark, d):
    return S.raw(spark, d, "documents").select("doc_id").join(S.raw(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("orphan_anti_two", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) AND vec_id NOT IN (SELECT page_id FROM pages)")
def orphan_anti_two(spark, d):
    v = S.raw(spark, d, "embeddings").select("vec_id")
    return v.join(S.raw(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti").join(S.raw(spark, d, "pages").select(F.col("page_id").alias("vec_id")), "vec_id", "left_anti")


@query("expr_key_join", "SELECT e.event_id, p.p_partkey FROM events e JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)")
def expr_key_join(spark, d):
    e = S.raw(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("p_partkey"))
    return e.join(S.raw(spark, d, "part").select("p_partkey"), "p_partkey").select("event_id", "p_partkey")


@query("or_join_as_union", "SELECT DISTINCT l_orderkey, l_linenumber, s_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey OR s_suppkey = l_partkey")
def or_join_as_union(spark, d):
    li = S.raw(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    out = J.either_key(li, S.raw(spark, d, "supplier").select("s_suppkey"), ["l_suppkey", "l_partkey"], "s_suppkey", ["l_orderkey", "l_linenumber", "s_suppkey"])
    return out.select("l_orderkey", "l_linenumber", "s_suppkey")


@query("token_intersection", "SELECT c_custkey FROM customer WHERE list_has_all(string_split(lower(replace(c_name, '#', ' ')), ' '), ['customer']) AND list_has_all(string_split(lower(c_mktsegment), ' '), ['building'])")
def token_intersection(spark, d):
    c = S.raw(spark, d, "customer")
    words = F.split(F.lower(F.concat_ws(" ", F.replace("c_name", F.lit("#"), F.lit(" ")), "c_mktsegment")), " ")
    return J.all_tokens(c, "c_custkey", words, ["customer", "building"])


@query("family_counts", " UNION ALL ".join(f"SELECT '{t}' AS family, count(*) AS n FROM {t}" for t in ("documents", "pages", "conversations", "events", "embeddings", "labels", "benchmark")))
def family_counts(spark, d):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [S.raw(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("family"), "n") for t in ("documents", "pages", "conversations", "events", "embeddings", "labels", "benchmark")])


@query("nested_completion", """SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (WHERE done = 1) AS completed, round(count(*) FILTER (WHERE done = 1) * 1.0 / count(*), 6) AS ratio FROM
 (SELECT o_orderkey, o_orderpriority, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS done FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) t GROUP BY 1""")
def nested_completion(spark, d):
    li = S.raw(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("done"))
    j = S.raw(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(li, "o_orderkey")
    done = F.count_if(F.col("done") == 1)
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), done.alias("completed"), F.round(done / F.count("*"), 6).alias("ratio"))


@query("budget_sum", "SELECT o_orderpriority, CAST(coalesce(sum(CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END), 0) AS DOUBLE) AS committed FROM orders GROUP BY 1")
def budget_sum(spark, d):
    price = F.when(F.col("o_orderstatus").isin("F", "O"), money("o_totalprice")).otherwise(0)
    return S.raw(spark, d, "orders").groupBy("o_orderpriority").agg(F.coalesce(F.sum(price), F.lit(0)).cast("double").alias("committed"))


@query("monthly_orders", "SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def monthly_orders(spark, d):
    return S.raw(spark, d, "orders").groupBy(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.sum(money("o_totalprice")).cast("double").alias("total"))


@query("constraint_checks", """SELECT 'events_unique' AS rule, count(*) AS violations FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1) a UNION ALL SELECT 'turn_unique', count(*) FROM (SELECT conv_id, turn FROM conversations GROUP BY 1, 2 HAVING count(*) > 1) b
 UNION ALL SELECT 'label_range', count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1) UNION ALL SELECT 'label_refers', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def constraint_checks(spark, d):
    from ..operators.quality import constraint_violations

    e, c, lab, docs = (S.raw(spark, d, t) for t in ("events", "conversations", "labels", "documents"))
    return constraint_violations({"events_unique": ("unique", e, ["event_id"]), "turn_unique": ("unique", c, ["conv_id", "turn"]), "label_range": ("where", lab, "quality not in (0, 1) or toxic not in (0, 1)"), "label_refers": ("refers", lab, (docs, "doc_id"))})


@query("cube_events", "SELECT event_type, direction, count(*) AS n FROM (SELECT event_type, CASE WHEN event_type IN ('click','view') THEN 'peer' WHEN event_type IN ('purchase','signup') THEN 'self' ELSE 'unknown' END AS direction FROM events) e GROUP BY ROLLUP (direction, event_type)")
def cube_events(spark, d):
    return S.interactions(spark, d).withColumnRenamed("kind", "event_type").rollup("direction", "event_type").agg(F.count("*").alias("n"))


# Vectors ------------------------------------------------------------------------------------

Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"


def query_vector(spark, d, key=0):
    return S.vectors(spark, d).filter(F.col("vec_id") == key).select(F.col("vector").alias("q"))


@query("cosine_topk", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 9) AS score FROM embeddings, {Q} x ORDER BY 2 DESC, 1 LIMIT 10")
def cosine_topk(spark, d):
    return R.top_vectors(S.vectors(spark, d), query_vector(spark, d), 10, "vec_id").select("vec_id", "score")


@query("cosine_topk_filtered", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 9) AS score FROM embeddings, {Q} x WHERE label = 3 ORDER BY 2 DESC, 1 LIMIT 10")
def cosine_topk_filtered(spark, d):
    return R.top_vectors(S.vectors(spark, d).filter("label = 3"), query_vector(spark, d), 10, "vec_id").select("vec_id", "score")


@query("ip_floor", f"SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), q), 9) AS score FROM embeddings, {Q} x WHERE round(list_inner_product(CAST(embedding AS DOUBLE[]), q), 9) >= 0.1 ORDER BY 2 DESC, 1 LIMIT 200")
def ip_floor(spark, d):
    return R.top_vectors(S.vectors(spark, d), query_vector(spark, d), 200, "vec_id", metric="inner", floor=0.1).select("vec_id", "score")


@query("nearest_of_many", """SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10""")
def nearest_of_many(spark, d):
    """A stated set of queries, every hundredth vector, against all."""
    v = S.vectors(spark, d)
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q"))
    return R.top_vectors_many(v, q, 10, "vec_id", "query_id").withColumn("rank", F.col("rank").cast("long"))


#: What episodes are asked for, and the letters whose counts are their vector.
ASKED, LETTERS = "notes about the order and its return", "aeinorst"
_COUNTS = ", ".join(f"CAST(length(body) - length(replace(body, '{c}', '')) AS DOUBLE)" for c in LETTERS)


@query("episode_hybrid", f"""WITH e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, lower(string_agg(role || ': ' || substring(text, 1, 220), chr(10)) OVER w) AS body FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 d AS (SELECT conv_id, turn, round(list_cosine_similarity([{_COUNTS}], [{", ".join(f"{ASKED.count(c)}.0" for c in LETTERS)}]), 9) AS dense, CAST((length(body) - length(replace(body, 'order', ''))) / 5 AS BIGINT) AS sparse FROM e WHERE (rn - 1) % 3 = 0),
 a AS (SELECT conv_id, turn, row_number() OVER (ORDER BY dense DESC, conv_id, turn) AS rank FROM d QUALIFY rank <= 100), b AS (SELECT conv_id, turn, row_number() OVER (ORDER BY sparse DESC, conv_id, turn) AS rank FROM d QUALIFY rank <= 100)
 SELECT conv_id AS conversation_id, turn AS center, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def episode_hybrid(spark, d):
    """Episodes ranked by a vector of their text and by a word of the question, fused by reciprocal ranks."""
    from ..operators.windows import episodes

    line = F.concat("sender", F.lit(": "), F.substring("content", 1, 220))
    e = episodes(S.messages(spark, d), "conversation_id", "local_id", line).withColumn("body", F.lower("episode_text"))
    count = lambda c: F.length("body") - F.length(F.replace("body", F.lit(c), F.lit("")))
    vector = F.array(*(count(c).cast("double") for c in LETTERS))
    e = e.select(F.struct("conversation_id", "center").alias("key"), vector.alias("vector"), (count("order") / 5).cast("long").alias("score"))
    q = spark.createDataFrame([([float(ASKED.count(c)) for c in LETTERS],)], "q array<double>")
    order = [F.desc("score"), F.asc("key")]
    dense = R.top_vectors(e.select("key", "vector"), q, 100, "key")
    lists = [R.route(dense.select("key", "score"), "dense", order, 100), R.route(e.select("key", "score"), "sparse", order, 100)]
    f = R.fuse_rrf(lists[0].unionByName(lists[1])).withColumn("score", F.round("score", 9)).orderBy(*order).limit(10)
    return f.select("key.conversation_id", "key.center", "score")


@query("score_floor_calibration", f"SELECT max(CASE WHEN label <> l0 THEN s END) AS max_negative, min(CASE WHEN label = l0 THEN s END) AS min_positive, max(CASE WHEN label <> l0 THEN s END) < min(CASE WHEN label = l0 THEN s END) AS separable FROM (SELECT label, (SELECT label FROM embeddings WHERE vec_id = 0) AS l0, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 9) AS s FROM embeddings, {Q} x WHERE vec_id <> 0) t")
def score_floor_calibration(spark, d):
    v = S.vectors(spark, d)
    q = v.filter("vec_id = 0").select(F.col("vector").alias("q"), F.col("label").alias("l0"))
    s = v.filter("vec_id <> 0").join(F.broadcast(q)).select("label", "l0", F.round(cosine(F.col("vector"), F.col("q")), 9).alias("s"))
    neg, pos = F.max(F.when(F.col("label") != F.col("l0"), F.col("s"))), F.min(F.when(F.col("label") == F.col("l0"), F.col("s")))
    return s.agg(neg.alias("max_negative"), pos.alias("min_positive"), (neg < pos).alias("separable"))


@query("dense_sparse_rrf", f"""WITH a AS (SELECT vec_id AS key, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 9) DESC, vec_id) AS rank FROM embeddings, {Q} x QUALIFY rank <= 50),
 b AS (SELECT doc_id AS key, row_number() OVER (ORDER BY CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50)
 SELECT key, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) r GROUP BY key""")
def dense_sparse_rrf(spark, d):
    from ..functions.text import count_of

    dense = R.top_vectors(S.vectors(spark, d), query_vector(spark, d), 50, "vec_id").select(F.col("vec_id").alias("key"), "score")
    docs = S.raw(spark, d, "documents")
    n = (F.length("text") - F.length(F.replace("text", F.lit("the"), F.lit("")))) / 3
    sparse = docs.select(F.col("doc_id").alias("key"), n.cast("long").alias("score"))
    order = [F.desc("score"), F.asc("key")]
    return R.fuse_rrf(R.route(dense, "dense", order, 50).unionByName(R.route(sparse, "sparse", order, 50))).select("key", F.round("score", 9).alias("score"))


# Star-schema reports ------------------------------------------------------------------------

@query("pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    li = S.raw(spark, d, "lineitem").filter(F.col("l_shipdate").cast("date") <= F.lit("1998-09-02").cast("date"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.sum(money("l_extendedprice") * (1 - money("l_discount"))).cast("double").alias("revenue"), F.count("*").alias("n"))


@query("nation_revenue", """SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def nation_revenue(spark, d):
    li = S.raw(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice") * (1 - money("l_discount"))).alias("r"))
    o = S.raw(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = S.raw(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return li.join(o, "o_orderkey").join(c, "c_custkey").join(S.raw(spark, d, "nation"), "n_nationkey").groupBy("n_name").agg(F.sum("r").cast("double").alias("revenue"))


@query("latest_order_per_customer", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) t WHERE n = 1")
def latest_order(spark, d):
    return first_by(S.raw(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("backoff", "SELECT event_id, least(30, 0.5 * pow(2, least(event_id % 9, 6))) AS exponential, least(300, (event_id % 12) * 30) AS linear FROM events")
def backoff(spark, d):
    n = F.col("event_id")
    return S.raw(spark, d, "events").select("event_id", F.least(F.lit(30.0), 0.5 * F.pow(F.lit(2.0), F.least(n % 9, F.lit(6)))).alias("exponential"), F.least(F.lit(300), (n % 12) * 30).alias("linear"))


@query("direction", "SELECT CASE WHEN event_type IN ('click','view') THEN 'peer' WHEN event_type IN ('purchase','signup') THEN 'self' ELSE 'unknown' END AS direction, count(*) AS n FROM events GROUP BY 1")
def direction(spark, d):
    return S.interactions(spark, d).groupBy("direction").agg(F.count("*").alias("n"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return S.raw(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("ts_parse", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts, '%Y-%m') AS month FROM events")
def ts_parse(spark, d):
    from ..sources.readers import parse_timestamp

    t = parse_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return S.raw(spark, d, "events").select("event_id", F.unix_seconds(t).alias("seconds"), F.date_format(t, "yyyy-MM").alias("month"))


@query("dev_holdout_split", "SELECT item_id, CASE WHEN CAST('0x' || substring(sha256(CAST(item_id AS VARCHAR)), 1, 4) AS BIGINT) % 5 = 0 THEN 'holdout' ELSE 'dev' END AS part FROM benchmark")
def dev_holdout_split(spark, d):
    h = F.conv(F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 4), 16, 10).cast("long")
    return S.raw(spark, d, "benchmark").select("item_id", F.when(h % 5 == 0, "holdout").otherwise("dev").alias("part"))
