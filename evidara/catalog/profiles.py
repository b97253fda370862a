"""Assembled profiles, job candidates, file lists and the episode route."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical as L
from ..operators import windows as W
from ..plans import profile as Q
from ..plans.profile import person_profiles
from ..sources import tables as S
from .documents import PHRASE, bm25_sql
from .messages import SESSIONS
from .registry import query


@query("person_profile", f"""WITH x AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS latest FROM {SESSIONS} s),
 c AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE direction = 'self') AS n_self, count(*) FILTER (WHERE direction = 'peer') AS n_peer, count(*) FILTER (WHERE direction = 'unknown') AS n_unknown, count(DISTINCT kind) AS kinds, min(ts) AS first_at, max(ts) AS last_at,
  CAST(max(session_no) AS BIGINT) AS sessions, count(*) FILTER (WHERE new_session = 1 AND direction = 'self') AS self_started, count(*) FILTER (WHERE new_session = 1 AND direction = 'peer') AS peer_started,
  count(*) FILTER (WHERE ts >= latest - INTERVAL 10 DAY) AS r, count(*) FILTER (WHERE ts >= latest - INTERVAL 20 DAY AND ts < latest - INTERVAL 10 DAY) AS p FROM x GROUP BY user_id)
 SELECT user_id, total, n_self, n_peer, n_unknown, kinds, first_at, last_at, sessions, self_started, peer_started, CASE WHEN r = p THEN 'equal' WHEN r > p THEN 'higher' ELSE 'lower' END AS trend FROM c""")
def person_profile(spark, d):
    return person_profiles(S.interactions(spark, d))


@query("job_candidates", """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS priority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')
 AND (EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') OR o_totalprice > 300000) ORDER BY 2, o_orderdate, o_orderkey LIMIT 100""")
def job_candidates(spark, d):
    from ..operators.joins import flagged

    orders = S.raw(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice", "o_orderdate")
    assets = S.raw(spark, d, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    scope = S.raw(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    jobs = flagged(orders.join(assets, "o_orderkey", "left_semi"), scope, "c_custkey", "in_scope").filter("in_scope or o_totalprice > 300000")
    priority = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return jobs.withColumn("priority", priority).orderBy("priority", "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "priority")


@query("file_evidence", """WITH f AS (SELECT page_id AS asset, 'page/' || page_id AS citation FROM pages WHERE contains(lower(url), 'e') UNION SELECT doc_id, 'page/' || doc_id FROM documents WHERE contains(text, '@mail'))
 SELECT asset, citation, (SELECT count(*) FROM f) AS total_candidates FROM f ORDER BY asset, citation LIMIT 100""")
def file_evidence(spark, d):
    cite = lambda c: F.concat(F.lit("page/"), F.col(c).cast("string")).alias("citation")
    a = S.raw(spark, d, "pages").filter(F.lower("url").contains("e")).select(F.col("page_id").alias("asset"), cite("page_id"))
    b = S.raw(spark, d, "documents").filter(F.col("text").contains("@mail")).select(F.col("doc_id").alias("asset"), cite("doc_id"))
    f = a.unionByName(b).dropDuplicates(["asset", "citation"])
    total = f.agg(F.count("*").alias("total_candidates"))  # one row
    return f.join(F.broadcast(total)).orderBy("asset", "citation").limit(100)


EPISODES = """(SELECT conv_id AS conversation_id, turn AS center, array_to_string(lines, chr(10)) AS episode_text FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
 list(turn || ' | ' || role || ' | ' || substring(text, 1, 220)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS lines FROM conversations) x WHERE (rn - 1) % 3 = 0)"""


@query("episode_search", f"SELECT conversation_id, center, round(score, 6) AS score FROM {bm25_sql(EPISODES + ' e', {'episode_text': 1.0})} s ORDER BY 3 DESC, 1, 2 LIMIT 20")
def episode_search(spark, d):
    line = F.concat_ws(" | ", F.col("local_id").cast("string"), "sender", F.substring("content", 1, 220))
    e = W.episodes(S.messages(spark, d), "conversation_id", "local_id", line).select("conversation_id", "center", "episode_text")
    s = L.bm25(e, PHRASE, {"episode_text": 1.0}).select("conversation_id", "center", F.round("score", 6).alias("score"))
    return s.orderBy(F.desc("score"), "conversation_id", "center").limit(20)


@query("group_contexts", """SELECT person, conversation, messages, first_at, last_at, kinds, place FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY messages DESC, conversation) AS place FROM (
 SELECT person, conversation, CAST(sum(n) AS BIGINT) AS messages, min(f) AS first_at, max(l) AS last_at, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds FROM (SELECT user_id % 10 AS person, user_id AS conversation, CASE WHEN event_id % 3 = 0 THEN 'image' ELSE 'text' END AS kind, count(*) AS n, min(ts) AS f, max(ts) AS l FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3) x GROUP BY 1, 2) y) z WHERE place <= 100""")
def group_contexts(spark, d):
    """Users as groups of ten persons: the hundred of most messages each, with their kinds."""
    kind = F.when(F.col("event_id") % 3 == 0, "image").otherwise("text")
    m = S.interactions(spark, d).select((F.col("user_id") % 10).alias("person"), F.col("user_id").alias("conversation"), "direction", kind.alias("kind"), F.col("ts").alias("at"))
    g = Q.group_contexts(m, ["person"])
    kinds = F.concat_ws(",", F.transform(F.map_entries("kinds"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return g.select("person", "conversation", "messages", "first_at", "last_at", kinds.alias("kinds"), F.col("place").cast("long").alias("place"))


CATEGORIES = {"goals_and_needs": ("the was",), "emotion_and_stress": ("idiot", "scum", "moron"), "gratitude_and_help": ("license",), "commitments_and_open_loops": ("the and", "and the")}
CATEGORY_SQL = " UNION ALL ".join(f"SELECT doc_id, source, n_chars, {i} AS o, '{c}' AS category FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) for i, (c, ws) in enumerate(CATEGORIES.items()))


@query("key_events", f"""WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY o) AS r FROM ({CATEGORY_SQL}) c) x WHERE r = 1), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, 'doc/' || doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM one)
 SELECT source, 'doc/' || doc_id AS citation, category FROM n WHERE c <= 5 OR i IN (SELECT CAST(round_even(j * (n.c - 1) / 4.0, 0) AS BIGINT) FROM range(0, 5) r(j))""")
def key_events(spark, d):
    from ..functions.text import keyword_labels

    docs = S.raw(spark, d, "documents").select("source", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("citation"), F.col("n_chars").alias("at"), F.explode(keyword_labels(F.col("text"), CATEGORIES)).alias("category"))
    return Q.key_events(docs, "source", 5).select("source", "citation", "category")


#: A word for each section that a text is routed to; the others are filled from other tables.
ROUTES = {"needs": "the was", "objections": "idiot", "commitments": "license", "next_actions": "?", "file_exchanges": "@mail"}
ROUTED = "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{s}'" for s, w in ROUTES.items()) + " END"
CLAIMS = f"""(SELECT source AS person, unnest(list_filter([{ROUTED}, 'chat_evidence', 'timeline_summary', CASE lang WHEN 'de' THEN 'moments_authored' WHEN 'fr' THEN 'moments_mentioned' WHEN 'es' THEN 'interactions' END, CASE WHEN lang IN ('de', 'fr') THEN 'moments' END], lambda x: x IS NOT NULL)) AS section, CASE WHEN doc_id % 9 = 0 THEN '12 !' ELSE substring(text, 1, 40) END AS value, 'doc/' || CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id END AS citations, doc_id AS rank FROM documents
 UNION ALL SELECT 'src' || (doc_id % 20), CASE WHEN toxic = 1 THEN 'observations' WHEN quality = 1 THEN 'image_observations' ELSE 'voice_transcripts' END, 'label ' || quality || toxic, 'label/' || doc_id, doc_id FROM labels
 UNION ALL SELECT 'src' || (page_id % 20), CASE WHEN page_id % 2 = 0 THEN 'pending_voice' ELSE 'identity' END, url, 'page/' || page_id, page_id FROM pages UNION ALL SELECT 'src1', 'ambiguities', 'several candidates', '', 0 UNION ALL SELECT 'src1', 'no such section', 'value', '', 0)"""


@query("customer_profile", rf"""SELECT person, section, place, value, citations FROM (SELECT *, row_number() OVER (PARTITION BY person, section ORDER BY rank, value) AS place FROM (SELECT person, section, value, citations, min(rank) AS rank FROM {CLAIMS} c
 WHERE section <> 'no such section' AND length(regexp_replace(value, '[^\p{{L}}\p{{N}}]+', '', 'g')) >= 2 AND NOT regexp_matches(regexp_replace(value, '[^\p{{L}}\p{{N}}]+', '', 'g'), '^[0-9]+$') GROUP BY 1, 2, 3, 4) x) y WHERE place <= 5""")
def customer_profile(spark, d):
    """All sections of each source's profile, from texts by their words, labels and pages."""
    from ..functions.text import contains_fold

    routed = F.lit(None).cast("string")
    for s, w in reversed(ROUTES.items()):
        routed = F.when(contains_fold(F.col("text"), w), s).otherwise(routed)
    lang = F.when(F.col("lang") == "de", "moments_authored").when(F.col("lang") == "fr", "moments_mentioned").when(F.col("lang") == "es", "interactions")
    sections = F.array_compact(F.array(routed, F.lit("chat_evidence"), F.lit("timeline_summary"), lang, F.when(F.col("lang").isin("de", "fr"), "moments")))
    i = F.col("doc_id")
    value = F.when(i % 9 == 0, "12 !").otherwise(F.substring("text", 1, 40))
    cited = F.concat(F.lit("doc/"), F.when(i % 4 == 0, 0).otherwise(i).cast("string"))
    docs = S.raw(spark, d, "documents").select(F.col("source").alias("person"), F.explode(sections).alias("section"), value.alias("value"), cited.alias("citations"), i.alias("rank"))
    person = lambda c: F.concat(F.lit("src"), (F.col(c) % 20).cast("string")).alias("person")
    section = F.when(F.col("toxic") == 1, "observations").when(F.col("quality") == 1, "image_observations").otherwise("voice_transcripts")
    labels = S.raw(spark, d, "labels").select(person("doc_id"), section.alias("section"), F.concat(F.lit("label "), F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("value"), F.concat(F.lit("label/"), i.cast("string")).alias("citations"), i.alias("rank"))
    p = F.col("page_id")
    pages = S.raw(spark, d, "pages").select(person("page_id"), F.when(p % 2 == 0, "pending_voice").otherwise("identity").alias("section"), F.col("url").alias("value"), F.concat(F.lit("page/"), p.cast("string")).alias("citations"), p.alias("rank"))
    some = spark.createDataFrame([("src1", "ambiguities", "several candidates", "", 0), ("src1", "no such section", "value", "", 0)], docs.schema)
    return Q.profile_sections(docs.unionByName(labels).unionByName(pages).unionByName(some), "person").select("person", "section", F.col("place").cast("long").alias("place"), "value", "citations")


@query("claim_validation", """WITH c AS (SELECT doc_id, ['needs', 'style', 'mood'][doc_id % 3 + 1] AS dimension, ['fact', 'pattern', 'hypothesis', 'unknown', 'action', 'rumour'][doc_id % 6 + 1] AS cls, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE 'claim' END AS statement, list_transform(range(0, doc_id % 10), lambda i: 'doc/' || (doc_id * (i + 1))) AS cs,
  doc_id % 2 = 0 AS reviewed, doc_id % 4 AS alt, (doc_id % 13) / 10.0::DOUBLE AS confidence, CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'scope' END AS scope FROM labels),
 k AS (SELECT *, (SELECT count(*) FROM (SELECT DISTINCT unnest(cs) AS x) u WHERE x NOT IN (SELECT 'doc/' || doc_id FROM documents)) AS lost, len(list_distinct(cs)) AS n FROM c)
 SELECT doc_id AS claim_id, CASE WHEN dimension = 'mood' THEN 'dimension' WHEN cls = 'rumour' THEN 'evidence_class' WHEN length(trim(statement)) = 0 THEN 'statement' WHEN cls <> 'unknown' AND n = 0 THEN 'uncited' WHEN n > 8 THEN 'too_many_citations' WHEN cls IN ('pattern', 'hypothesis') AND n < 3 THEN 'too_few_citations'
  WHEN cls = 'hypothesis' AND alt = 0 THEN 'no_alternative' WHEN cls IN ('pattern', 'hypothesis') AND NOT reviewed THEN 'not_reviewed' WHEN lost > 0 THEN 'citation_not_found' WHEN confidence > 1 THEN 'confidence' WHEN scope = '' THEN 'scope' END AS error,
  least(confidence, CASE cls WHEN 'fact' THEN 0.99 WHEN 'pattern' THEN 0.85 WHEN 'hypothesis' THEN 0.7 WHEN 'unknown' THEN 0.0 WHEN 'action' THEN 0.8 END::DOUBLE) AS confidence FROM k""")
def claim_validation(spark, d):
    i = F.col("doc_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    cited = F.when(i % 10 > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(i % 10, F.lit(1))), lambda k: F.concat(F.lit("doc/"), (i * k).cast("string")))).otherwise(F.array().cast("array<string>"))
    claims = S.raw(spark, d, "labels").select(
        i.alias("claim_id"), pick(["needs", "style", "mood"]).alias("dimension"), pick(["fact", "pattern", "hypothesis", "unknown", "action", "rumour"]).alias("evidence_class"), F.when(i % 17 == 0, " ").otherwise("claim").alias("statement"),
        cited.alias("citations"), F.array().cast("array<string>").alias("counterevidence"), (i % 2 == 0).alias("reviewed"), F.when(i % 4 > 0, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("alternatives"),
        ((i % 13) / 10.0).alias("confidence"), F.when(i % 19 == 0, "").otherwise("scope").alias("scope"),
    )
    evidence = S.raw(spark, d, "documents").select(F.concat(F.lit("doc/"), i.cast("string")).alias("citation"))
    return Q.claim_errors(claims, evidence, ("needs", "style")).select("claim_id", "error", "confidence")


@query("contact_listing", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0 ORDER BY lower(c_name), c_custkey LIMIT 200")
def contact_listing(spark, d):
    c = S.raw(spark, d, "customer").filter("c_acctbal > 0")
    return c.orderBy(F.lower("c_name"), "c_custkey").limit(200).select("c_custkey", "c_name", "c_mktsegment")


@query("favorite_listing", "SELECT doc_id, source, substring(text, 1, 240) AS preview FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 100")
def favorite_listing(spark, d):
    docs = S.raw(spark, d, "documents").filter("lang = 'de'").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return docs.select("doc_id", "source", F.substring("text", 1, 240).alias("preview"))


@query("observation_listing", "SELECT l.doc_id, quality, toxic, source FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality = 0 OR toxic = 1 ORDER BY toxic DESC, l.doc_id LIMIT 100")
def observation_listing(spark, d):
    lab = S.raw(spark, d, "labels").filter("quality = 0 or toxic = 1")
    return lab.join(S.raw(spark, d, "documents").select("doc_id", "source"), "doc_id").orderBy(F.desc("toxic"), "doc_id").limit(100).select("doc_id", "quality", "toxic", "source")


@query("customer_card", f"SELECT person, max(value) FILTER (WHERE section = 'identity') AS identity, max(value) FILTER (WHERE section = 'needs') AS need, max(value) FILTER (WHERE section = 'next_actions') AS action FROM (SELECT *, row_number() OVER (PARTITION BY person, section ORDER BY rank, value) AS place FROM {CLAIMS} c WHERE section IN ('identity', 'needs', 'next_actions') AND length(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) >= 2 AND NOT regexp_matches(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '^[0-9]+$')) x WHERE place = 1 GROUP BY person")
def customer_card(spark, d):
    """The first value of a few sections."""
    p = customer_profile(spark, d).filter("place = 1 and section in ('identity', 'needs', 'next_actions')")
    of = lambda s: F.max(F.when(F.col("section") == s, F.col("value")))
    return p.groupBy("person").agg(of("identity").alias("identity"), of("needs").alias("need"), of("next_actions").alias("action"))
