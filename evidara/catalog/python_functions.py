"""Queries of functions that run as pandas UDFs; tested against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..sources import tables as S
from .registry import query


def last_of(pattern: str) -> str:
    return f"CASE WHEN contains(w, '{pattern}') THEN length(w) - length('{pattern}') - instr(reverse(w), reverse('{pattern}')) + 1 ELSE -1 END"


CUT = f"greatest({', '.join(last_of(p) for p in ('。', '！', '？', '. ', '; '))})"
CHUNKED = rf"""(WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')) AS t FROM documents),
 c AS (SELECT doc_id, 0 AS i, 0::BIGINT AS a, substring(t, 1, 900) AS w, t FROM t WHERE length(t) > 0
  UNION ALL SELECT doc_id, i + 1, b - 120, substring(t, b - 119, 900), t FROM (SELECT *, a + CASE WHEN a + length(w) < length(t) AND {CUT} > 495 THEN {CUT} + 1 ELSE length(w) END AS b FROM c) x WHERE b < length(t))
 SELECT doc_id, i AS chunk_index, trim(CASE WHEN a + length(w) < length(t) AND {CUT} > 495 THEN substring(w, 1, {CUT} + 1) ELSE w END) AS chunk FROM c)"""


@query("chunk_text_udtf", f"SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, length(chunk) AS size, sha256(chunk) AS digest FROM {CHUNKED} k")
def chunk_text(spark, d):
    c = S.raw(spark, d, "documents").select("doc_id", F.posexplode(P.chunk_text("text")).alias("chunk_index", "chunk"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk").cast("long").alias("size"), F.sha2("chunk", 256).alias("digest"))


def _unescaped(text: str) -> str:
    """With the references that pages have resolved, & last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", chr(34)), ("#39", "''"), ("nbsp", chr(160)), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return text


_BARE = "html"
for _block in ("<script\\b[^>]*>.*?</script\\s*>", "<style\\b[^>]*>.*?</style\\s*>", "<title\\b[^>]*>.*?</title\\s*>", "<!--.*?-->", "<[!/]?[a-zA-Z][^>]*>"):
    _BARE = f"regexp_replace({_BARE}, '{_block}', ' ', 'gis')"
_SPACE = "[\\s\\x{A0}]+"
#: Tags and blocks cut away by patterns, as far as well-formed pages go.
PAGES = f"""SELECT page_id, CASE WHEN html IS NULL OR trim(html) = '' THEN 'empty' WHEN contains(html, '<!ENTITY') THEN 'rejected' ELSE 'parsed' END AS status,
 trim({_unescaped("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}) AS title, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<a [^>]*href="[^"]+"')) AS links,
 sha256(trim(regexp_replace({_unescaped(_BARE)}, '{_SPACE}', ' ', 'g'))) AS text_digest FROM pages"""


@query("html_parse_udf", PAGES)
def html_parse(spark, d):
    p = S.raw(spark, d, "pages").select("page_id", P.parsed_page("html").alias("p"))
    return p.select("page_id", "p.status", "p.title", "p.lang", "p.links", F.sha2("p.text", 256).alias("text_digest"))


EMBEDDED = f"""WITH k AS MATERIALIZED (SELECT doc_id, chunk_index, lower(chunk) AS t FROM {CHUNKED} c WHERE length(chunk) > 0),
 w AS (SELECT doc_id, chunk_index, token, count(*) AS c FROM (SELECT doc_id, chunk_index, unnest(list_concat(list_transform(range(1, length(t) + 1), lambda i: substring(t, i, 1)), list_transform(range(1, length(t)), lambda i: substring(t, i, 2)))) AS token FROM k) x GROUP BY 1, 2, 3),
 h AS MATERIALIZED (SELECT token, CAST('0x' || substring(sha256(token), 1, 8) AS BIGINT) % 32 AS b, CASE WHEN substring(sha256(token), 10, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE -1 END AS s FROM (SELECT DISTINCT token FROM w) t),
 v AS (SELECT doc_id, chunk_index, b, sum(c * s) AS x FROM w JOIN h ON h.token = w.token GROUP BY 1, 2, 3), n AS (SELECT doc_id, chunk_index, sqrt(sum(x * x)::DOUBLE) AS n FROM v GROUP BY 1, 2)
 SELECT n.doc_id, CAST(n.chunk_index AS BIGINT) AS chunk_index, string_agg(CAST(round(coalesce(v.x, 0)::DOUBLE / CASE WHEN n.n = 0 THEN 1 ELSE n.n END * 1000000) AS BIGINT), ',' ORDER BY d.i) AS embedding FROM n CROSS JOIN range(0, 32) d(i) LEFT JOIN v ON v.doc_id = n.doc_id AND v.chunk_index = n.chunk_index AND v.b = d.i GROUP BY 1, 2"""


@query("hash_embedding_udf", EMBEDDED)
def hash_embedding(spark, d):
    """Of all chunks of the documents, in millionths."""
    c = S.raw(spark, d, "documents").select("doc_id", F.posexplode(P.chunk_text("text")).alias("chunk_index", "chunk"))
    millionths = F.transform(P.embedded("chunk"), lambda x: F.round(x * 1_000_000).cast("long").cast("string"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join(millionths, ",").alias("embedding"))


@query("normalize_identifier_udf", "SELECT c_custkey, lower(trim(c_name)) AS name FROM customer")
def normalize_identifier(spark, d):
    return S.raw(spark, d, "customer").select("c_custkey", P.normalize_identifier("c_name").alias("name"))
