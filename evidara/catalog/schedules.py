"""Queries of schedules, statuses and evaluation grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import schedules as K
from ..sources import tables as S
from .registry import query


@query("debounced_runs", """SELECT user_id, CAST(s AS BIGINT) AS session_no, count(*) AS changes, CAST(floor(max(epoch(ts))) AS BIGINT) + 3600 AS due_second FROM (SELECT *, SUM(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
 (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR epoch(ts) - epoch(LAG(ts) OVER w) >= 3600 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a) b GROUP BY user_id, s""")
def debounced_runs(spark, d):
    return K.debounced(S.raw(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 3600)


@query("retry_state", """WITH o AS (SELECT user_id, max(ts) FILTER (WHERE event_type <> 'error') AS ok FROM events GROUP BY user_id), f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND (ok IS NULL OR ts > ok)) AS failures FROM events JOIN o USING (user_id) GROUP BY user_id)
 SELECT user_id, failures, failures >= 3 AS blocked, CASE WHEN failures > 0 THEN least(30.0, 0.5 * pow(2, least(failures - 1, 6))) ELSE 0.0 END AS wait_seconds FROM f""")
def retry_state(spark, d):
    e = S.raw(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    return K.retry_state(e, ["user_id"], "ts", "event_id", "failed")


@query("understanding_status", "SELECT lang, count(*) AS total, count(*) FILTER (WHERE len(list_distinct([lang, substring(source, 1, 4), CAST(doc_id % 2 AS VARCHAR)])) > 2) AS multi, CAST(sum(doc_id % 3) AS BIGINT) AS hits FROM documents GROUP BY lang")
def understanding_status(spark, d):
    listed = F.from_json(F.to_json(F.array("lang", F.substring("source", 1, 4), (F.col("doc_id") % 2).cast("string"))), "array<string>")
    return S.raw(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("total"), F.count_if(F.size(F.array_distinct(listed)) > 2).alias("multi"), F.sum(F.col("doc_id") % 3).alias("hits"))


@query("promotion", """WITH t AS (SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') ORDER BY length(text) DESC, conv_id, turn LIMIT 1),
 c AS (SELECT n.conv_id, n.turn, CASE WHEN n.turn < t.turn THEN 'before' WHEN n.turn > t.turn THEN 'after' ELSE 'top' END AS side, abs(n.turn - t.turn) AS far FROM conversations n JOIN t ON n.conv_id = t.conv_id)
 SELECT conv_id, turn, side FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY far) AS r FROM c) x WHERE r = 1""")
def promotion(spark, d):
    c = S.raw(spark, d, "conversations")
    top = c.filter(F.lower("text").contains("the")).orderBy(F.desc(F.length("text")), "conv_id", "turn").limit(1).select("conv_id", "turn", F.lit(1).alias("rank"))
    return K.promoted(top, c.select("conv_id", "turn"), "conv_id", "turn")


@query("item_parse_udf", """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'rejected' WHEN 1 THEN 'malformed' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'empty' WHEN 4 THEN 'rejected' WHEN 5 THEN 'unsupported' ELSE 'parsed' END AS status,
 CASE WHEN page_id % 8 < 6 THEN '' WHEN page_id % 3 = 0 THEN 'link' ELSE 'quote' END AS kind,
 CASE WHEN page_id % 8 IN (2, 6, 7) THEN trim(regexp_replace(regexp_replace(url, '[<&]', ' ', 'g'), '\\s+', ' ', 'g')) ELSE '' END AS title FROM pages""")
def item_parse(spark, d):
    """Shared items in the XML form of exports, made here of pages, parsed in batches: those that declare a type or are
    too long, are broken, of an unknown type, empty, or no item at all, are told apart."""
    title = F.regexp_replace("url", "[<&]", " ")
    kind = F.when(F.col("page_id") % 8 == 2, "999").when(F.col("page_id") % 3 == 0, "5").otherwise("57")
    xml = F.concat(F.lit("<msg><appmsg><type>"), kind, F.lit("</type><title>"), title, F.lit("</title></appmsg></msg>"))
    case = F.col("page_id") % 8
    xml = (
        F.when(case == 0, F.concat(F.lit("<!DOCTYPE msg>"), xml)).when(case == 1, F.concat(xml, F.lit("<open>"))).when(case == 3, F.lit(" "))
        .when(case == 4, F.concat(xml, F.repeat(F.lit(" "), 256 * 1024))).when(case == 5, F.concat(F.lit("<msg><title>"), title, F.lit("</title></msg>"))).otherwise(xml)
    )
    p = S.raw(spark, d, "pages").select("page_id", parsing.parsed_item(xml).alias("p"))
    return p.select("page_id", "p.status", "p.kind", "p.title")
