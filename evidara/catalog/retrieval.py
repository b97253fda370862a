"""Queries of hybrid search over messages and documents, with all six routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lexical_index import kept_index
from ..plans.search import Corpus, SearchRequest, search
from ..sources import tables as S
from .registry import query

PHRASE = "the and"
EVIDENCE = """(SELECT 'msg/' || conv_id || '/' || turn AS citation, text AS content, 'conversation ' || conv_id AS title, role AS actor, CAST(conv_id AS VARCHAR) AS conversation, conv_id * 1000 + turn AS sent, 'message' AS source_type FROM conversations
 UNION ALL SELECT 'doc/' || doc_id, text, source, lang, NULL, -1, 'document' FROM documents)"""


def hits(column: str, phrase: str = "p") -> str:
    return f"CAST((length(lower({column})) - length(replace(lower({column}), {phrase}, ''))) / length({phrase}) AS BIGINT)"


def size(*columns: str) -> str:
    return " + ".join(f"greatest(length({c}) - 2, 0)" for c in columns)


def bm25(n: str, nw: str, tf: str, length: str, mean: str) -> str:
    return f"round(greatest(ln(({n} - {nw} + 0.5) / ({nw} + 0.5)), 1e-6::DOUBLE) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {length} / {mean})), 6)"


def top(name: str, order: str, n: int, source: str, columns: str = "citation, key") -> str:
    return f"{name} AS (SELECT {columns}, row_number() OVER (ORDER BY {order}) AS rank FROM {source} QUALIFY rank <= {n})"


def routes_sql(phrase: str, expanded: list[str], lexical: int, vector: int, fts: int) -> str:
    """exact, evidence, vector and fts as tables of (citation, key, rank), from the rules of each."""
    values = ", ".join(f"({i}, '{q}')" for i, q in enumerate(dict.fromkeys([phrase, *expanded])))
    turns = {q: i for i, q in enumerate(dict.fromkeys([phrase, *expanded]))}
    asked = " UNION ALL ".join(f"SELECT citation, {i} AS turn, row_number() OVER (ORDER BY score DESC, sent DESC, citation) AS r FROM mb WHERE q = {turns[q]} QUALIFY r <= {fts}" for i, q in enumerate(expanded))
    return f"""e AS MATERIALIZED (SELECT * FROM {EVIDENCE} x), m AS MATERIALIZED (SELECT *, {size('content', 'title', 'actor')} AS len FROM e WHERE source_type = 'message'), qs(q, p) AS (VALUES {values}),
 mt AS (SELECT * FROM (SELECT q, citation, sent, len, {hits('content')} + {hits('title')} + {hits('actor')} AS tf FROM m, qs) x WHERE tf > 0), ms AS (SELECT count(*) AS n, avg(len) AS mean FROM m), mw AS (SELECT q, count(*) AS nw FROM mt GROUP BY q),
 mb AS MATERIALIZED (SELECT mt.q, citation, sent, {bm25('n', 'nw', 'tf', 'len', 'mean')} AS score FROM mt JOIN mw ON mw.q = mt.q, ms),
 {top('exact', 'score DESC, sent DESC, citation', lexical, '(SELECT *, citation AS key FROM mb WHERE q = 0) x')},
 c AS (SELECT citation AS key, citation || '#chunk-' || i AS citation, title, actor, sent, substring(content, i * 780 + 1, 900) AS chunk, '{phrase}' AS p FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((length(content) - 120) / 780.0) AS BIGINT), 1))) AS i FROM e) x),
 ct AS MATERIALIZED (SELECT *, {size('chunk', 'title', 'actor')} AS len, {hits('chunk')} * 1.0::DOUBLE + {hits('title')} * 3.5::DOUBLE + {hits('actor')} * 0.8::DOUBLE AS tf FROM c), cs AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (WHERE tf > 0) AS nw FROM ct),
 cb AS (SELECT citation, key, sent, {bm25('n', 'nw', 'tf', 'len', 'mean')} AS score, CASE WHEN contains(lower(title), p) THEN 0 WHEN contains(lower(chunk), p) THEN 1 ELSE 2 END AS tier FROM ct, cs WHERE tf > 0),
 {top('evidence', 'score DESC, tier, sent DESC, citation', lexical, 'cb')},
 v AS (SELECT 'doc/' || vec_id AS key, 'doc/' || vec_id || '#chunk-0' AS citation, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings),
 {top('vector', 'score DESC, citation', vector, 'v')},
 fa AS ({asked}), ff AS (SELECT citation, citation AS key, min((turn, r)) AS o FROM fa GROUP BY citation), {top('fts', 'o', fts, 'ff')}"""


FEATURES = """round(f.score + CASE WHEN contains(body, '{p}') THEN 6.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(title), '{p}') THEN 2.5::DOUBLE WHEN contains(lower(part), '{p}') THEN 0.75::DOUBLE ELSE 0 END
 + CASE WHEN contains(body, 'the') THEN 1.25::DOUBLE ELSE 0 END + CASE WHEN contains(body, 'and') THEN 1.25::DOUBLE ELSE 0 END
 + CASE WHEN list_contains(paths, 'exact') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN list_contains(paths, 'evidence') THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN list_contains(paths, 'vector') THEN 0.4::DOUBLE ELSE 0 END, 6)"""
WEIGHT = "CASE route WHEN 'exact' THEN 2.0 WHEN 'evidence' THEN 10.0 WHEN 'vector' THEN 1.0 WHEN 'fts' THEN 4.0 WHEN 'conversation-context' THEN 8.0 ELSE 12.0 END::DOUBLE"
SNIPPET = "CASE WHEN hit > 0 THEN (CASE WHEN hit > 61 THEN '…' ELSE '' END) || substring(part, greatest(hit - 60, 1), least(hit + {n} + 59, length(part)) - greatest(hit - 60, 1) + 1) || (CASE WHEN hit + {n} + 59 < length(part) THEN '…' ELSE '' END) ELSE substring(part, 1, 120) END"


def fused_sql(phrase: str, listed: str) -> str:
    """From listed (citation, key, rank, route, turn) to placed rows, re-ranked by features."""
    return f"""f AS (SELECT key, round(sum({WEIGHT} / (60 + rank)), 9) AS score, list_sort(list_distinct(list(route))) AS paths, first(citation ORDER BY turn, rank) AS own FROM {listed} GROUP BY key ORDER BY 2 DESC, 1 LIMIT 200),
 h AS (SELECT f.*, title, actor, source_type, conversation, sent, CASE WHEN contains(own, '#') THEN substring(content, CAST(split_part(own, '#chunk-', 2) AS BIGINT) * 780 + 1, 900) ELSE content END AS part FROM f JOIN e ON e.citation = f.key),
 t AS (SELECT f.*, CASE WHEN row_number() OVER (ORDER BY score DESC, key) <= 50 THEN 0 ELSE 1 END AS tier, lower(part || chr(10) || title || chr(10) || actor || chr(10) || source_type) AS body FROM h f),
 z AS (SELECT key, own, paths, part, conversation, sent, tier, CASE WHEN tier = 0 THEN {FEATURES.format(p=phrase)} ELSE score END AS score FROM t f),
 placed AS (SELECT *, row_number() OVER (ORDER BY tier, score DESC, sent, key) AS place, instr(lower(part), '{phrase}') AS hit FROM z)"""


LISTED = """l AS (SELECT *, 'exact' AS route, 0 AS turn FROM exact UNION ALL SELECT *, 'evidence', 1 FROM evidence UNION ALL SELECT *, 'vector', 2 FROM vector UNION ALL SELECT *, 'fts', 3 FROM fts)"""
HOPS = f"""o AS (SELECT key, min((turn, rank)) AS o FROM l GROUP BY key ORDER BY 2 LIMIT 10), n AS (SELECT citation, conversation, sent, row_number() OVER (PARTITION BY conversation ORDER BY sent, citation) AS n FROM m),
 g AS (SELECT conversation, n AS centre, o FROM n JOIN o ON o.key = n.citation), ctx AS (SELECT n.citation, n.citation AS key, min((o, n.n)) AS o FROM n JOIN g ON g.conversation = n.conversation AND n.n BETWEEN centre - 3 AND centre + 3 GROUP BY n.citation), {top('context', 'o', 70, 'ctx')},
 ep AS (SELECT * FROM (SELECT conversation, sent AS center, row_number() OVER (PARTITION BY conversation ORDER BY sent) AS rn, array_to_string(list(sent || ' | ' || actor || ' | ' || substring(content, 1, 220)) OVER w, chr(10)) AS body, min(sent) OVER w AS a, max(sent) OVER w AS b
  FROM m WINDOW w AS (PARTITION BY conversation ORDER BY sent ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) x WHERE (rn - 1) % 3 = 0),
 et AS (SELECT *, {hits('body', f"'{PHRASE}'")} * 1.0::DOUBLE AS tf, greatest(length(body) - 2, 0) AS len FROM ep), es AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (WHERE tf > 0) AS nw FROM et),
 eb AS (SELECT conversation, center, a, b, {bm25('n', 'nw', 'tf', 'len', 'mean')} AS score FROM et, es WHERE tf > 0), {top('best', 'score DESC, conversation, center', 10, 'eb', 'conversation, a, b')},
 em AS (SELECT m.citation, m.citation AS key, min((best.rank, m.sent)) AS o FROM m JOIN best ON best.conversation = m.conversation AND m.sent BETWEEN a AND b GROUP BY m.citation), {top('episode', 'o', 70, 'em')},
 every AS (SELECT * FROM l UNION ALL SELECT *, 'conversation-context', 4 FROM context UNION ALL SELECT *, 'episode-evidence', 5 FROM episode)"""
PROMOTED = """lead AS (SELECT key AS k, conversation AS c, sent AS s FROM placed ORDER BY CASE WHEN list_contains(paths, 'episode-evidence') THEN 0 ELSE 1 END, place LIMIT 1),
 sd AS (SELECT placed.*, CASE WHEN key = k THEN 'top' WHEN coalesce(conversation = c, FALSE) AND list_contains(paths, 'conversation-context') THEN CASE WHEN sent < s THEN 'before' ELSE 'after' END ELSE 'rest' END AS side FROM placed, lead),
 sn AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY place) AS i, (SELECT count(DISTINCT side) FROM sd WHERE side IN ('before', 'after')) AS sides FROM sd),
 sg AS (SELECT *, CASE WHEN sides = 0 OR side = 'top' THEN 0 WHEN side IN ('before', 'after') AND (i = 1 OR (sides = 1 AND i = 2)) THEN 1 WHEN side = 'rest' THEN 2 ELSE 3 END AS grp FROM sn),
 final AS (SELECT *, row_number() OVER (ORDER BY grp, CASE WHEN grp IN (1, 3) AND side <> 'before' THEN 1 ELSE 0 END, place) AS rank FROM sg)"""
SHOWN = "own AS citation, key AS context_anchor, round(score, 6) AS score, array_to_string(paths, ',') AS paths, " + SNIPPET.format(n=len(PHRASE)) + " AS snippet"


def index_of(spark, d):
    """The kept index of evidence, made where there is none."""
    return kept_index("evidence", S.evidence(spark, d), "citation", ["content", "title", "actor"])


def corpus(spark, d):
    e = S.evidence(spark, d)
    v = S.vectors(spark, d)
    chunk = F.concat(F.lit("doc/"), F.col("vec_id").cast("string"), F.lit("#chunk-0"))
    return Corpus(
        e, index_of(spark, d), "message", v.select(chunk.alias("citation"), "vector"),
        v.filter("vec_id = 0").select(F.col("vector").alias("q")), lambda citations: S.evidence(spark, d, citations),
    )


@query("hybrid_search", f"WITH {routes_sql(PHRASE, [PHRASE, 'the', 'and'], 30, 20, 30)}, {LISTED}, {HOPS}, {fused_sql(PHRASE, 'every')}, {PROMOTED} SELECT rank, {SHOWN} FROM final ORDER BY rank LIMIT 10")
def hybrid_search(spark, d):
    """A multi-hop question with vectors: six routes, and the promoted chain."""
    return search(corpus(spark, d), SearchRequest(PHRASE, limit=10, semantic="on", multi_hop=True))


@query("lexical_search", f"WITH {routes_sql(PHRASE, [PHRASE, 'the', 'and'], 60, 40, 60)}, l AS (SELECT *, 'exact' AS route, 0 AS turn FROM exact UNION ALL SELECT *, 'evidence', 1 FROM evidence UNION ALL SELECT *, 'fts', 2 FROM fts), {fused_sql(PHRASE, 'l')} SELECT place AS rank, {SHOWN} FROM placed ORDER BY place LIMIT 20")
def lexical_search(spark, d):
    """Lexical routes alone, which give enough."""
    return search(corpus(spark, d), SearchRequest(PHRASE, limit=20, semantic="off"))


@query("indexed_statistics", f"""WITH e AS (SELECT * FROM {EVIDENCE} x), c AS (SELECT citation, title, actor, substring(content, i * 780 + 1, 900) AS chunk FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((length(content) - 120) / 780.0) AS BIGINT), 1))) AS i FROM e) x),
 m AS (SELECT count(*) AS rows, avg({size('content', 'title', 'actor')}) AS mean FROM e WHERE source_type = 'message'), k AS (SELECT count(*) AS chunks, avg({size('chunk', 'title', 'actor')}) AS chunk_mean FROM c) SELECT rows, round(mean, 6) AS mean, chunks, round(chunk_mean, 6) AS chunk_mean FROM m, k""")
def indexed_statistics(spark, d):
    """Rows and mean lengths of messages and chunks, from the lengths that the index keeps, without the texts."""
    from ..plans.search import sizes

    return sizes(corpus(spark, d)).select("rows", F.round("mean", 6).alias("mean"), "chunks", F.round("chunk_mean", 6).alias("chunk_mean"))
