"""Queries over conversations and timed interactions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as T
from ..operators import filters as P
from ..operators import windows as W
from ..sources import tables as S
from .registry import query

MESSAGES = """(SELECT conv_id AS conversation_id, turn AS local_id, role AS sender, text AS content,
 CASE role WHEN 'user' THEN 'incoming' WHEN 'assistant' THEN 'outgoing' ELSE 'unknown' END AS direction,
 'msg/' || conv_id || '/' || turn AS citation FROM conversations)"""
INTERACTIONS = """(SELECT event_id, user_id, ts, event_type AS kind, value, props,
 CASE WHEN event_type IN ('click','view') THEN 'peer' WHEN event_type IN ('purchase','signup') THEN 'self' ELSE 'unknown' END AS direction FROM events)"""
SESSIONS = f"""(SELECT *, SUM(new_session) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM
 (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR epoch(ts) - epoch(LAG(ts) OVER w) >= 28800 THEN 1 ELSE 0 END AS new_session
  FROM {INTERACTIONS} i WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) s)"""


@query("recall_timeline", f"SELECT conversation_id, local_id, sender, content, citation FROM {MESSAGES} m WHERE conversation_id = 3 AND direction <> 'unknown' AND contains(lower(content), 'the') ORDER BY local_id LIMIT 100")
def recall_timeline(spark, d):
    m = S.messages(spark, d).filter(P.message_filter({"conversation_id": 3}) & (F.col("direction") != "unknown") & T.contains_fold(F.col("content"), "the"))
    return m.orderBy("local_id").limit(100).drop("direction")


@query("recall_coverage", f"SELECT count(*) AS matched_total, least(count(*), 100) AS returned, greatest(count(*) - 100, 0) AS remaining, CASE WHEN count(*) > 100 THEN 'partial' ELSE 'complete' END AS state FROM {MESSAGES} m WHERE direction = 'incoming'")
def recall_coverage(spark, d):
    return P.coverage(S.messages(spark, d).filter("direction = 'incoming'"), 100)


@query("group_summary", f"SELECT sender, count(*) AS messages, count(DISTINCT conversation_id) AS conversations, CAST(sum(length(content)) AS BIGINT) AS characters FROM {MESSAGES} m GROUP BY sender")
def group_summary(spark, d):
    return S.messages(spark, d).groupBy("sender").agg(F.count("*").alias("messages"), F.countDistinct("conversation_id").alias("conversations"), F.sum(F.length("content")).alias("characters"))


@query("newest_n_then_asc", "SELECT event_id, ts, event_type FROM (SELECT * FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 50) t ORDER BY ts, event_id")
def newest_n_then_asc(spark, d):
    e = S.raw(spark, d, "events").filter("user_id = 7").select("event_id", "ts", "event_type")
    return P.newest_ascending(e, 50, [F.desc("ts"), F.desc("event_id")], [F.asc("ts"), F.asc("event_id")])


@query("filter_builder_since_until", "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def filter_builder(spark, d):
    f = {"event_type": "click", "since": "2024-01-05 00:00:00", "until": "2024-01-20 12:00:00", "user_id": None}
    return S.raw(spark, d, "events").filter(P.message_filter(f, time="ts")).select("event_id", "user_id", "value")


@query("recall_until_exclusive", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'")
def recall_until_exclusive(spark, d):
    f = {"since": "2024-01-05 00:00:00", "until": "2024-01-06 00:00:00"}
    return S.raw(spark, d, "events").filter(P.message_filter(f, time="ts", until_inclusive=False)).agg(F.count("*").alias("n"))


@query("sender_contains", f"SELECT citation, sender FROM {MESSAGES} m WHERE contains(lower(sender), 'ass') OR sender = 'ASS'")
def sender_contains(spark, d):
    return S.messages(spark, d).filter(P.message_filter({"sender": "ASS"})).select("citation", "sender")


@query("prefilter_then_match", "SELECT event_id, ts, props FROM (SELECT * FROM events WHERE user_id = 11 ORDER BY ts DESC, event_id DESC LIMIT 100) t WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def prefilter_then_match(spark, d):
    e = S.raw(spark, d, "events").filter("user_id = 11").select("event_id", "ts", "props")
    even = F.get_json_object("props", "$.k").cast("long") % 2 == 0
    return P.newest_then(e, 100, [F.desc("ts"), F.desc("event_id")], even)


@query("conversation_listing", f"SELECT conversation_id, count(*) AS messages, max(local_id) AS last_local_id, count(DISTINCT sender) AS senders FROM {MESSAGES} m GROUP BY conversation_id")
def conversation_listing(spark, d):
    return S.messages(spark, d).groupBy("conversation_id").agg(F.count("*").alias("messages"), F.max("local_id").alias("last_local_id"), F.countDistinct("sender").alias("senders"))


@query("candidates_max_ts", "SELECT user_id, max(ts) AS last_ts, count(*) AS n, CASE WHEN user_id = 42 THEN 0 ELSE 1 END AS tier FROM events WHERE CAST(user_id AS VARCHAR) LIKE '%42%' GROUP BY user_id")
def candidates_max_ts(spark, d):
    e = S.raw(spark, d, "events").filter(F.col("user_id").cast("string").contains("42"))
    return e.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n")).withColumn("tier", F.when(F.col("user_id") == 42, 0).otherwise(1)).orderBy("tier", F.desc("last_ts"), "user_id")


@query("waterline_snapshot", "SELECT user_id, max(event_id) AS max_local, max(ts) AS max_time FROM events GROUP BY user_id")
def waterline_snapshot(spark, d):
    from ..sources.readers import waterlines

    return waterlines(S.raw(spark, d, "events"), ["user_id"], "event_id", "ts")


@query("waterline_read", """WITH m AS (SELECT user_id, max(event_id) AS max_local, max(ts) AS max_time FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id)
 SELECT e.event_id, e.user_id, NOT coalesce(e.event_id > m.max_local OR e.ts > m.max_time, TRUE) AS late FROM events e LEFT JOIN m USING (user_id)""")
def waterline_read(spark, d):
    from ..sources.readers import newer_than, waterlines

    e = S.raw(spark, d, "events")
    marks = waterlines(e.filter("ts < timestamp_ntz '2024-01-15 00:00:00'"), ["user_id"], "event_id", "ts")
    return newer_than(e, marks, ["user_id"], "event_id", "ts").select("event_id", "user_id", "late")


@query("sessions_8h", f"""SELECT user_id, max(session_no)::BIGINT AS sessions, count(*) FILTER (WHERE new_session = 1 AND direction = 'self') AS self_started,
 count(*) FILTER (WHERE new_session = 1 AND direction = 'peer') AS peer_started FROM {SESSIONS} x GROUP BY user_id""")
def sessions_8h(spark, d):
    s = W.with_sessions(S.interactions(spark, d), ["user_id"], "ts", "event_id", 28_800)
    start = F.col("new_session") == 1
    return s.groupBy("user_id").agg(F.max("session_no").alias("sessions"), F.count_if(start & (F.col("direction") == "self")).alias("self_started"), F.count_if(start & (F.col("direction") == "peer")).alias("peer_started"))


@query("sessions_spread", f"SELECT event_id, user_id, new_session, CAST(session_no AS BIGINT) AS session_no FROM {SESSIONS} x")
def sessions_spread(spark, d):
    """Sessions of each event, by ranges that part even one user's events."""
    s = W.spread_sessions(S.interactions(spark, d).select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", 28_800)
    return s.select("event_id", "user_id", "new_session", "session_no")


@query("spread_numbers", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events")
def spread_numbers(spark, d):
    """Row numbers of a few very large groups."""
    return W.spread_numbers(S.raw(spark, d, "events").select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"]).drop("ts")


@query("response_latency_median", f"""SELECT user_id, direction, count(*) AS answers, round(median(minutes), 2) AS median_minutes FROM
 (SELECT user_id, direction, new_session, (epoch(ts) - epoch(LAG(ts) OVER w)) / 60.0 AS minutes, LAG(direction) OVER w AS before FROM {SESSIONS} x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) y
 WHERE new_session = 0 AND direction IN ('self','peer') AND before IN ('self','peer') AND direction <> before GROUP BY user_id, direction""")
def response_latency_median(spark, d):
    s = W.with_sessions(S.interactions(spark, d), ["user_id"], "ts", "event_id", 28_800)
    r = W.response_minutes(s, ["user_id"], "ts", "event_id", "direction")
    return r.groupBy("user_id", "direction").agg(F.count("*").alias("answers"), F.round(F.median("minutes"), 2).alias("median_minutes"))


@query("context_window", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
 a AS (SELECT conv_id, turn AS anchor, rn AS at FROM n WHERE turn % 5 = 2)
 SELECT n.conv_id AS conversation_id, a.anchor, n.turn AS local_id, n.rn - a.at AS "offset", n.text AS content FROM n JOIN a ON n.conv_id = a.conv_id AND n.rn BETWEEN a.at - 3 AND a.at + 3""")
def context_window(spark, d):
    m = S.messages(spark, d).select("conversation_id", "local_id", "content")
    return W.context_of(m, m.filter("local_id % 5 = 2"), "conversation_id", "local_id", 3, 3)


@query("multi_hop_context", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
 a AS (SELECT conv_id, turn AS anchor, rn AS at FROM n WHERE contains(lower(text), 'the') ORDER BY conv_id, turn LIMIT 10)
 SELECT n.conv_id AS conversation_id, n.turn AS local_id, min(abs(n.rn - a.at)) AS distance FROM n JOIN a ON n.conv_id = a.conv_id AND n.rn BETWEEN a.at - 3 AND a.at + 3 GROUP BY n.conv_id, n.turn""")
def multi_hop_context(spark, d):
    m = S.messages(spark, d).select("conversation_id", "local_id", "content")
    anchors = m.filter(T.contains_fold(F.col("content"), "the")).orderBy("conversation_id", "local_id").limit(10)
    near = W.context_of(m, anchors, "conversation_id", "local_id", 3, 3)
    return near.groupBy("conversation_id", "local_id").agg(F.min(F.abs("offset")).alias("distance"))


@query("episodes_stride3", """SELECT conv_id AS conversation_id, turn AS center, string_agg_text AS episode_text, members, first_order, last_order FROM (
 SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, array_to_string(list(turn || ' | ' || role || ' | ' || substring(text, 1, 220)) OVER f, chr(10)) AS string_agg_text,
 count(*) OVER f AS members, min(turn) OVER f AS first_order, max(turn) OVER f AS last_order FROM conversations WINDOW f AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) x WHERE (rn - 1) % 3 = 0""")
def episodes_stride3(spark, d):
    line = F.concat_ws(" | ", F.col("local_id").cast("string"), "sender", F.substring("content", 1, 220))
    return W.episodes(S.messages(spark, d), "conversation_id", "local_id", line)


@query("neighbor_text", f"SELECT citation, substring(LAG(content) OVER w, 1, 240) AS previous_text, substring(LEAD(content) OVER w, 1, 240) AS next_text, LAG(sender) OVER w AS previous_actor, LEAD(sender) OVER w AS next_actor FROM {MESSAGES} m WINDOW w AS (PARTITION BY conversation_id ORDER BY local_id)")
def neighbor_text(spark, d):
    w = Window.partitionBy("conversation_id").orderBy("local_id")
    m = S.messages(spark, d)
    return m.select("citation", *(F.substring(f("content").over(w), 1, 240).alias(f"{n}_text") for n, f in (("previous", F.lag), ("next", F.lead))), *(f("sender").over(w).alias(f"{n}_actor") for n, f in (("previous", F.lag), ("next", F.lead))))


@query("spread_sample", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events)
 SELECT DISTINCT n.event_id, n.user_id FROM n JOIN (SELECT * FROM range(0, 5) r(j)) r ON n.c <= 5 OR n.i = CAST(round_even(r.j * (n.c - 1) / 4.0, 0) AS BIGINT)""")
def spread_sample(spark, d):
    return W.spread_sample(S.raw(spark, d, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id", "user_id")


@query("latest_per_key", "SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n = 1")
def latest_per_key(spark, d):
    return W.first_by(S.raw(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "ts")


@query("keep_newest_k", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n <= 5")
def keep_newest_k(spark, d):
    return W.newest_k(S.raw(spark, d, "events"), ["user_id"], 5, F.desc("ts"), F.desc("event_id")).select("event_id", "user_id")


@query("resequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events WHERE event_type = 'purchase'")
def resequence(spark, d):
    e = S.raw(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return W.resequenced(e, ["user_id"], F.asc("ts"), F.asc("event_id")).drop("ts")


@query("context_style", """SELECT role, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(text, '^\\[.*\\]$')) AS n_text, median(length(text)) AS median_length,
 round(avg(CASE WHEN contains(text, '?') THEN 1.0 ELSE 0.0 END), 6) AS question_ratio FROM conversations GROUP BY role""")
def context_style(spark, d):
    c = S.raw(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_if(~F.col("text").rlike(r"^\[.*\]$")).alias("n_text"), F.median(F.length("text")).alias("median_length"), F.round(F.avg(F.col("text").contains("?").cast("double")), 6).alias("question_ratio"))


@query("activity_trend", """WITH l AS (SELECT user_id, max(ts) AS latest FROM events GROUP BY user_id),
 c AS (SELECT user_id, count(*) FILTER (WHERE ts >= latest - INTERVAL 10 DAY) AS recent, count(*) FILTER (WHERE ts >= latest - INTERVAL 20 DAY AND ts < latest - INTERVAL 10 DAY) AS previous FROM events JOIN l USING (user_id) GROUP BY user_id)
 SELECT user_id, recent, previous, CASE WHEN recent = previous THEN 'equal' WHEN recent > previous THEN 'higher' ELSE 'lower' END AS trend FROM c""")
def activity_trend(spark, d):
    e = S.raw(spark, d, "events").select("user_id", "ts")
    e = e.withColumn("latest", F.max("ts").over(Window.partitionBy("user_id")))
    near, far = F.expr("latest - interval 10 days"), F.expr("latest - interval 20 days")
    c = e.groupBy("user_id").agg(F.count_if(F.col("ts") >= near).alias("recent"), F.count_if((F.col("ts") >= far) & (F.col("ts") < near)).alias("previous"))
    return c.withColumn("trend", F.when(F.col("recent") == F.col("previous"), "equal").when(F.col("recent") > F.col("previous"), "higher").otherwise("lower"))


@query("monthly_timeline", f"""SELECT strftime(ts, '%Y-%m') AS month, count(*) AS messages, count(*) FILTER (WHERE direction = 'self') AS self, count(*) FILTER (WHERE direction = 'peer') AS peer,
 count(*) FILTER (WHERE direction = 'unknown') AS unknown FROM {INTERACTIONS} i GROUP BY 1 ORDER BY 1 DESC LIMIT 60""")
def monthly_timeline(spark, d):
    i = S.interactions(spark, d).groupBy(F.date_format("ts", "yyyy-MM").alias("month"))
    return i.agg(F.count("*").alias("messages"), *(F.count_if(F.col("direction") == k).alias(k) for k in ("self", "peer", "unknown"))).orderBy(F.desc("month")).limit(60)


@query("person_counts", f"""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE direction = 'self') AS self, count(*) FILTER (WHERE direction = 'peer') AS peer, count(DISTINCT kind) AS kinds,
 min(ts) AS first_at, max(ts) AS last_at FROM {INTERACTIONS} i GROUP BY user_id""")
def person_counts(spark, d):
    return S.interactions(spark, d).groupBy("user_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("direction") == k).alias(k) for k in ("self", "peer")), F.countDistinct("kind").alias("kinds"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("media_status", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(count(DISTINCT user_id) * 1.0 / (SELECT count(DISTINCT user_id) FROM events), 4) AS ratio FROM events GROUP BY event_type")
def media_status(spark, d):
    e = S.raw(spark, d, "events")
    every = e.agg(F.countDistinct("user_id").alias("every"))  # one row
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return g.join(F.broadcast(every)).select("event_type", "n", "users", F.round(F.when(F.col("every") == 0, 1.0).otherwise(F.col("users") / F.col("every")), 4).alias("ratio"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return S.raw(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


@query("events_sliding", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - s * INTERVAL 30 MINUTE AS window_start, count(*) AS n FROM events, (SELECT * FROM range(0, 2) r(s)) r GROUP BY 1")
def events_sliding(spark, d):
    return S.raw(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


@query("events_session", """SELECT user_id, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, SUM(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
 (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR epoch(ts) - epoch(LAG(ts) OVER w) >= 28800 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a) b GROUP BY user_id, s""")
def events_session(spark, d):
    e = S.raw(spark, d, "events").groupBy("user_id", F.session_window("ts", "28800 seconds").alias("w"))
    return e.agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).select("user_id", F.col("w.start").alias("session_start"), "last_ts", "n")


@query("rounds_fixed_gap", """WITH s AS (SELECT *, SUM(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM
 (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR epoch(ts) - epoch(LAG(ts) OVER w) >= 3600 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a),
 p AS (SELECT *, CAST(floor((epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id, sess))) / 1800) AS BIGINT) AS part_no FROM s)
 SELECT user_id, CAST(sess AS BIGINT) AS session_no, part_no, count(*) AS n, min(event_id) AS first_event FROM p GROUP BY user_id, sess, part_no""")
def rounds_fixed_gap(spark, d):
    s = W.capped_sessions(S.raw(spark, d, "events"), ["user_id"], "ts", "event_id", 3600, 1800)
    return s.groupBy("user_id", "session_no", "part_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("conversation_card", f"""SELECT conversation_id, count(*) FILTER (WHERE contains(content, '?')) AS questions, count(*) FILTER (WHERE contains(lower(content), 'the')) AS decisions,
 min(CASE WHEN contains(content, '?') THEN local_id END) AS first_question FROM {MESSAGES} m GROUP BY conversation_id""")
def conversation_card(spark, d):
    m = S.messages(spark, d)
    asks = F.col("content").contains("?")
    return m.groupBy("conversation_id").agg(F.count_if(asks).alias("questions"), F.count_if(T.contains_fold(F.col("content"), "the")).alias("decisions"), F.min(F.when(asks, F.col("local_id"))).alias("first_question"))


@query("refresh_coalesce", "SELECT user_id, min(ts) AS due_at, count(*) AS pending FROM events WHERE event_type = 'error' GROUP BY user_id")
def refresh_coalesce(spark, d):
    return S.raw(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("due_at"), F.count("*").alias("pending"))


@query("chunk_filter", "SELECT doc_id FROM documents WHERE (contains(lower(lang), 'e') OR lang = 'E') AND source = 'src3' AND n_chars >= 0")
def chunk_filter(spark, d):
    docs = S.raw(spark, d, "documents").select("doc_id", F.col("lang").alias("actor"), F.col("source").alias("source_id"))
    return docs.filter(P.chunk_filter({"sender": "E", "conversation_id": "src3", "conversation_type": "group"})).select("doc_id")


@query("residual_filter", "SELECT event_id FROM events WHERE (contains(event_type, 'i') OR CAST(user_id AS VARCHAR) = 'i') AND CASE WHEN user_id % 2 = 0 THEN 'group' ELSE 'private' END = 'group'")
def residual_filter(spark, d):
    kind = F.when(F.col("user_id") % 2 == 0, "group").otherwise("private")
    e = S.raw(spark, d, "events").select("event_id", F.col("event_type").alias("actor"), F.col("user_id").cast("string").alias("actor_id"), kind.alias("conversation_type"))
    return e.filter(P.residual({"sender": "i", "conversation_type": "group"})).select("event_id")


@query("guarded_scan", "WITH a AS (SELECT doc_id, text FROM documents WHERE lang = 'de'), b AS (SELECT doc_id, text FROM documents WHERE source = 'src3') SELECT 'wide' AS kind, doc_id FROM a WHERE contains(lower(text), 'die') AND (SELECT count(*) FROM a) <= 20 UNION ALL SELECT 'narrow', doc_id FROM b WHERE contains(lower(text), 'e') AND (SELECT count(*) FROM b) <= 100000")
def guarded_scan(spark, d):
    docs, text = S.raw(spark, d, "documents"), F.col("text")
    wide = P.guarded_scan(docs, F.col("lang") == "de", T.contains_fold(text, "die"), 20).select(F.lit("wide").alias("kind"), "doc_id")
    return wide.unionByName(P.guarded_scan(docs, F.col("source") == "src3", T.contains_fold(text, "e"), 100_000).select(F.lit("narrow").alias("kind"), "doc_id"))


@query("resolve_contact", "SELECT c_mktsegment, c_nationkey, CASE WHEN min(c_custkey) = max(c_custkey) THEN min(c_custkey) END AS c_custkey, CASE WHEN min(c_custkey) = max(c_custkey) THEN 'ok' ELSE 'ambiguous' END AS status FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2")
def resolve_contact(spark, d):
    c = S.raw(spark, d, "customer").filter("c_acctbal > 5000")
    return P.resolved(c, ["c_mktsegment", "c_nationkey"], "c_custkey")


@query("account_snapshot", f"SELECT citation, conversation_id, local_id, row_number() OVER (ORDER BY conversation_id, local_id) AS place FROM {MESSAGES} m WHERE sender = 'user' QUALIFY place <= 500")
def account_snapshot(spark, d):
    """An ordered scan with a bounded fetch."""
    m = S.messages(spark, d).filter("sender = 'user'").orderBy("conversation_id", "local_id").limit(500)
    return m.withColumn("place", F.row_number().over(Window.orderBy("conversation_id", "local_id")).cast("long")).select("citation", "conversation_id", "local_id", "place")


@query("cited_report", f"SELECT section, citation, substring(content, 1, 120) AS line FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY conversation_id, local_id) AS n FROM (SELECT *, unnest(list_filter([CASE WHEN contains(lower(content), 'the') THEN 'decision' END, CASE WHEN contains(lower(content), 'and') THEN 'owner' END, CASE WHEN contains(content, '?') THEN 'question' END], lambda x: x IS NOT NULL)) AS section FROM {MESSAGES} m) a) b WHERE n <= 10")
def cited_report(spark, d):
    """The first lines of each key word's section, each with its citation."""
    words = {"decision": ("the",), "owner": ("and",), "question": ("?",)}
    m = S.messages(spark, d).withColumn("section", F.explode(T.keyword_labels(F.col("content"), words)))
    top = W.newest_k(m, ["section"], 10, F.asc("conversation_id"), F.asc("local_id"))
    return top.select("section", "citation", F.substring("content", 1, 120).alias("line"))
