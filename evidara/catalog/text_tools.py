"""Queries of text tools: labels, tokens, tags, intervals, canonical forms, redaction, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as T
from ..sources import tables as S
from .registry import query

BLANK_SQL = "[ \\t\\n\\r\\f\\x0B\\x{00A0}\\x{3000}]+"
#: Vowels as Chinese characters, so that tokenisers of mixed text have some.
MIXED = "translate(lower(text), 'aeiou', '甲乙丙丁戊')"


def mixed():
    return F.translate(F.lower("text"), "aeiou", "甲乙丙丁戊")


@query("safe_label", f"SELECT page_id, CASE WHEN length(s) > 0 THEN s ELSE 'untitled' END AS label FROM (SELECT page_id, substring(regexp_replace(trim(regexp_replace(CASE WHEN page_id % 10 = 0 THEN ' ' ELSE html END, '{BLANK_SQL}', ' ', 'g')), '[/\\\\\\x00-\\x1f]+', '-', 'g'), 1, 80) AS s FROM pages) p")
def safe_label(spark, d):
    title = F.when(F.col("page_id") % 10 == 0, " ").otherwise(F.col("html"))
    return S.raw(spark, d, "pages").select("page_id", T.safe_label(title).alias("label"))


@query("page_slug", "SELECT doc_id, CASE WHEN length(s) > 0 THEN substring(s, 1, 80) ELSE 'wiki-page' END AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(trim(translate(lower(text), 'aeiou', '甲乙丙丁戊')), '[^0-9A-Za-z\\x{4e00}-\\x{9fff}_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents) x")
def page_slug(spark, d):
    return S.raw(spark, d, "documents").select("doc_id", T.page_slug(mixed()).alias("slug"))


TOKENS = f"list_distinct(regexp_extract_all({MIXED}, '[A-Za-z0-9_]+|[\\x{{3400}}-\\x{{9fff}}]+'))"


@query("query_tokens", f"SELECT doc_id, len({TOKENS}) AS n, array_to_string(list_sort({TOKENS}), ' ') AS tokens FROM documents")
def query_tokens(spark, d):
    t = T.query_tokens(mixed())
    return S.raw(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(F.array_sort(t), " ").alias("tokens"))


@query("shingle_tokens", f"""SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY t) AS tokens FROM (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(CASE WHEN regexp_matches(r, '^[\\x{{4e00}}-\\x{{9fff}}]') THEN CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END WHEN length(r) >= 2 THEN [r] ELSE CAST([] AS VARCHAR[]) END) AS t
 FROM (SELECT doc_id, unnest(regexp_extract_all({MIXED}, '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]+')) AS r FROM documents) x) y) z GROUP BY doc_id""")
def shingle_tokens(spark, d):
    """Exploded as a list of one, so that the tokens of a text are made once for the filter, the count and the list."""
    t = S.raw(spark, d, "documents").select("doc_id", F.explode(F.array(T.shingle_tokens(mixed()))).alias("t"))
    return t.filter("size(t) > 0").select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


TAGS = {"legal": ("license", "rights"), "contact": ("@mail", "+1 ("), "question": ("?",), "insult": ("idiot", "scum")}
TAGS_SQL = "array_to_string(list_filter([CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'rights') THEN 'legal' END, CASE WHEN contains(lower(text), '@mail') OR contains(lower(text), '+1 (') THEN 'contact' END, CASE WHEN contains(text, '?') THEN 'question' END, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') THEN 'insult' END], lambda x: x IS NOT NULL), ',')"


@query("intent_tags", f"SELECT doc_id, {TAGS_SQL} AS tags FROM documents")
def intent_tags(spark, d):
    return S.raw(spark, d, "documents").select("doc_id", F.array_join(T.keyword_labels(F.col("text"), TAGS), ",").alias("tags"))


@query("interval_seconds", """SELECT event_id, CASE WHEN s >= 60 THEN s END AS seconds, CASE WHEN h <= 23 AND m <= 59 THEN h * 60 + m END AS minutes FROM (SELECT event_id, k * CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 60 WHEN 'purchase' THEN 3600 WHEN 'signup' THEN 86400 END AS s, k % 30 AS h, event_id % 70 AS m
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e) x""")
def interval_seconds(spark, d):
    """Errors have a unit that there is not."""
    k = F.get_json_object("props", "$.k")
    unit = F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "view", " m").when(F.col("event_type") == "purchase", "H").when(F.col("event_type") == "signup", "d ").otherwise("x")
    clock = F.concat((k.cast("long") % 30).cast("string"), F.lit(":"), F.lpad((F.col("event_id") % 70).cast("string"), 2, "0"))
    return S.raw(spark, d, "events").select("event_id", T.interval_seconds(F.concat(k, unit)).alias("seconds"), T.clock_minutes(clock).alias("minutes"))


@query("canonical_json", """SELECT event_id, sha256('{"event_id":' || event_id || ',"kind":"' || event_type || '","note":' || CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || CAST(user_id AS VARCHAR) || '"' END || ',"user_id":' || user_id || '}') AS digest FROM events""")
def canonical_json(spark, d):
    note = F.when(F.col("event_type") != "view", F.col("user_id").cast("string"))
    j = T.canonical_json(user_id=F.col("user_id"), kind=F.col("event_type"), event_id=F.col("event_id"), note=note)
    return S.raw(spark, d, "events").select("event_id", F.sha2(j, 256).alias("digest"))


@query("redact_trace", """SELECT event_id, '{"count":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ',"field_' || substring(sha256('who'), 1, 12) || '":["redacted-text:' || substring(sha256(event_type), 1, 12) || '","redacted-path:' || substring(sha256('/Users/' || event_type), 1, 12) || '"],"field_' || substring(sha256('k'), 1, 12) || '":"redacted-number"}' AS redacted FROM events""")
def redact_trace(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    record = F.to_json(F.struct(k.alias("k"), k.alias("count"), F.array(F.col("event_type"), F.concat(F.lit("/Users/"), "event_type")).alias("who")))
    return S.raw(spark, d, "events").withColumn("record", record).select("event_id", P.redacted_trace("record", ["status"], ["count"]).alias("redacted"))


@query("unique_names", """SELECT page_id, CASE WHEN i = 0 THEN stem || '.html' ELSE stem || '-' || i || '.html' END AS name FROM (SELECT page_id, stem, dense_rank() OVER (PARTITION BY stem ORDER BY first_id) - 1 AS i FROM (SELECT page_id, stem, min(page_id) OVER (PARTITION BY stem, h) AS first_id FROM (SELECT page_id, regexp_extract(url, '^https?://([a-z]+)\\.', 1) AS stem, md5(html) AS h FROM pages) a) b) c""")
def unique_names(spark, d):
    """Files of one name: equal contents share a name, others are numbered in order of their first file."""
    from ..operators.joins import unique_names as named

    p = S.raw(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([a-z]+)\\.", 1).alias("stem"), F.md5("html").alias("content"))
    return named(p, "stem", ".html", "content", "page_id").select("page_id", "name")


@query("decode_bytes", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(text, chr(0)) ELSE substring(text, 1, 0) || '价格' || (doc_id % 7) END AS text FROM documents")
def decode_bytes(spark, d):
    """Bytes in UTF-8, and bytes of GB18030 of odd length."""
    gb = F.concat(F.unhex(F.lit("BCDBB8F1")), F.encode((F.col("doc_id") % 7).cast("string"), "US-ASCII"))
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(gb)
    return S.raw(spark, d, "documents").withColumn("raw", raw).select("doc_id", P.decoded(F.col("raw")).alias("text"))
