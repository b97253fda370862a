"""Queries over documents: text functions, lexical and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical as L
from ..operators.lexical_index import kept_index
from ..operators import ranking as R
from ..operators import windows as W
from ..sources import tables as S
from .registry import query

PHRASE = "the and"
BLANK_SQL = "[ \\t\\n\\r\\f\\x0B\\x{00A0}\\x{3000}]+"
NORM = "trim(regexp_replace(text, '%s', ' ', 'g'))" % BLANK_SQL


def hits(column, phrase=PHRASE):
    return f"CAST((length(lower({column})) - length(replace(lower({column}), '{phrase}', ''))) / {len(phrase)} AS BIGINT)"


def bm25_sql(table, weights, phrase=PHRASE, extra="*"):
    tf = " + ".join(f"{hits(f'coalesce({c}, {chr(39) * 2})', phrase)} * {w}" for c, w in weights.items())
    size = " + ".join(f"greatest(length(coalesce({c}, '')) - 2, 0)" for c in weights)
    return f"""(SELECT {extra}, greatest(ln((nn - nw + 0.5) / (nw + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al)) AS score FROM
 (SELECT *, count(*) OVER () AS nn, avg(len) OVER () AS al, count(*) FILTER (WHERE tf > 0) OVER () AS nw FROM (SELECT *, {tf} AS tf, {size} AS len FROM {table}) a) b WHERE tf > 0)"""


CHUNKS = """(SELECT doc_id, source, chunk_index, substring(text, chunk_index * 780 + 1, 900) AS chunk FROM
 (SELECT *, unnest(range(0, greatest(CAST(ceil((length(text) - 120) / 780.0) AS BIGINT), 1))) AS chunk_index FROM documents) c)"""


@query("substring_fallback", f"SELECT doc_id, source FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(source), 'idiot') ORDER BY doc_id DESC LIMIT 100")
def substring_fallback(spark, d):
    docs = S.raw(spark, d, "documents")
    return docs.filter(T.contains_fold(F.col("text"), "idiot") | T.contains_fold(F.col("source"), "idiot")).orderBy(F.desc("doc_id")).limit(100).select("doc_id", "source")


@query("spanning_phrase", f"SELECT doc_id FROM documents WHERE lower({NORM}) LIKE '%and%the%was%'")
def spanning_phrase(spark, d):
    return S.raw(spark, d, "documents").filter(T.spanning(F.col("text"), "and\tThe was")).select("doc_id")


@query("normalize_text", f"SELECT doc_id, sha256({NORM}) AS digest, length({NORM}) AS size FROM documents")
def normalize_text(spark, d):
    t = T.normalize_text(F.col("text"))
    return S.raw(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), F.length(t).cast("long").alias("size"))


@query("bounded_text", f"SELECT doc_id, CASE WHEN length({NORM}) > 80 THEN rtrim(substring({NORM}, 1, 79)) || '…' ELSE {NORM} END AS preview FROM documents")
def bounded_text(spark, d):
    return S.raw(spark, d, "documents").select("doc_id", T.bounded(F.col("text"), 80).alias("preview"))


@query("slug", "SELECT url, CASE WHEN length(s) > 0 THEN substring(s, 1, 80) ELSE 'untitled' END AS slug FROM (SELECT url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages) p")
def slug(spark, d):
    return S.raw(spark, d, "pages").select("url", T.slug(F.col("url")).alias("slug"))


@query("snippet", f"""SELECT doc_id, CASE WHEN hit > 0 THEN (CASE WHEN a > 1 THEN '…' ELSE '' END) || substring(text, a, b - a + 1) || (CASE WHEN b < length(text) THEN '…' ELSE '' END) ELSE substring(text, 1, 120) END AS snippet
 FROM (SELECT *, greatest(hit - 60, 1) AS a, least(hit + {len(PHRASE) + 59}, length(text)) AS b FROM (SELECT doc_id, text, instr(lower(text), '{PHRASE}') AS hit FROM documents) x) y""")
def snippet(spark, d):
    return S.raw(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), PHRASE).alias("snippet"))


@query("stable_id", "SELECT doc_id, substring(sha256(CAST(doc_id AS VARCHAR) || chr(31) || source), 1, 16) AS id FROM documents")
def stable_id(spark, d):
    return S.raw(spark, d, "documents").select("doc_id", T.stable_id(F.col("doc_id").cast("string"), F.col("source")).alias("id"))


@query("redact", "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[email]', 'g'), '[0-9a-f]{24,}', '[token]', 'g'), '(/[A-Za-z0-9._-]+){3,}', '[path]', 'g')) AS digest FROM documents")
def redact(spark, d):
    return S.raw(spark, d, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("digest"))


@query("compact_overlap", """SELECT doc_id, contains(regexp_replace(lower(text), '[\\s!-/:-@\\[-`{-~]+', '', 'g'), 'theandof') AS literal, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), ['the', 'and', 'nicht', 'les'])) AS overlap FROM documents""")
def compact_overlap(spark, d):
    words = F.array(*map(F.lit, ("the", "and", "nicht", "les")))
    return S.raw(spark, d, "documents").select("doc_id", T.compact(F.col("text")).contains("theandof").alias("literal"), F.size(F.array_intersect(T.latin_tokens(F.col("text")), words)).cast("long").alias("overlap"))


GROUPS = {"legal": ("license", "rights reserved"), "insult": ("idiot", "scum", "moron"), "contact": ("@mail", "+1 (")}


@query("keyword_categories", """SELECT category, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(list_filter([CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'rights reserved') THEN 'legal' END,
 CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') OR contains(lower(text), 'moron') THEN 'insult' END,
 CASE WHEN contains(lower(text), '@mail') OR contains(lower(text), '+1 (') THEN 'contact' END], lambda x: x IS NOT NULL)) AS category FROM documents) t GROUP BY category""")
def keyword_categories(spark, d):
    docs = S.raw(spark, d, "documents").select("doc_id", F.explode(T.keyword_labels(F.col("text"), GROUPS)).alias("category"))
    return docs.groupBy("category").agg(F.countDistinct("doc_id").alias("n"))


@query("route_section", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '?') THEN 'question' ELSE 'note' END AS section FROM documents")
def route_section(spark, d):
    t = F.col("text")
    return S.raw(spark, d, "documents").select("doc_id", T.first_match([(T.contains_fold(t, "license"), "legal"), (t.contains("@"), "contact"), (t.contains("?"), "question")], "note").alias("section"))


@query("low_signal", "SELECT doc_id, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < 12 AND NOT regexp_matches(text, '[0-9]') AS low_signal FROM documents")
def low_signal(spark, d):
    t = F.col("text")
    return S.raw(spark, d, "documents").select("doc_id", ((F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")) < 12) & ~t.rlike("[0-9]")).alias("low_signal"))


@query("content_kind_classify", """SELECT page_id, CASE WHEN contains(html, chr(65533)) THEN 'unknown_binary' WHEN contains(lower(html), '<video') THEN 'video' WHEN contains(lower(html), '<img') THEN 'image' WHEN contains(lower(html), '<table') THEN 'table' ELSE 'text' END AS kind FROM pages""")
def content_kind_classify(spark, d):
    h = F.lower("html")
    rules = [(F.col("html").contains("�"), "unknown_binary"), (h.contains("<video"), "video"), (h.contains("<img"), "image"), (h.contains("<table"), "table")]
    return S.raw(spark, d, "pages").select("page_id", T.first_match(rules, "text").alias("kind"))


@query("scope_classify_hist", """SELECT scope, count(*) AS n FROM (SELECT CASE WHEN NOT starts_with(url, 'http') THEN 'invalid' WHEN contains(url, '?') THEN 'query' WHEN length(url) - length(replace(url, '/', '')) > 4 THEN 'deep' ELSE 'page' END AS scope FROM pages) p GROUP BY scope""")
def scope_classify_hist(spark, d):
    u = F.col("url")
    rules = [(~u.startswith("http"), "invalid"), (u.contains("?"), "query"), (F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit(""))) > 4, "deep")]
    return S.raw(spark, d, "pages").groupBy(T.first_match(rules, "page").alias("scope")).agg(F.count("*").alias("n"))


@query("file_type", "SELECT url, CASE WHEN e IN ('html', 'htm') THEN 'page' WHEN e IN ('png', 'jpg', 'gif') THEN 'image' WHEN e IN ('pdf', 'doc') THEN 'document' ELSE 'other' END AS kind FROM (SELECT url, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM pages) p")
def file_type(spark, d):
    kinds = {"page": ("html", "htm"), "image": ("png", "jpg", "gif"), "document": ("pdf", "doc")}
    return S.raw(spark, d, "pages").select("url", T.file_kind(F.col("url"), kinds).alias("kind"))


@query("citation_parts", f"SELECT DISTINCT split_part(citation, '#', 1) AS parent, split_part(split_part(citation, '#', 1), '/', 2) AS doc FROM (SELECT 'doc/' || doc_id || '#chunk-' || chunk_index AS citation FROM {CHUNKS} c) t")
def citation_parts(spark, d):
    c = L.fixed_chunks(S.raw(spark, d, "documents"), "doc_id", "text").select(F.concat(F.lit("doc/"), F.col("citation")).alias("citation"))
    parent = F.substring_index("citation", "#", 1)
    return c.select(parent.alias("parent"), F.split_part(parent, F.lit("/"), F.lit(2)).alias("doc")).distinct()


@query("fixed_chunks", f"SELECT doc_id, chunk_index, length(chunk) AS size, sha256(chunk) AS digest FROM {CHUNKS} c")
def fixed_chunks(spark, d):
    c = L.fixed_chunks(S.raw(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk").cast("long").alias("size"), F.sha2("chunk", 256).alias("digest"))


@query("vector_document_text", f"SELECT doc_id, sha256('title: ' || source || chr(10) || 'lang: ' || lang || CASE WHEN contains(lower(text), 'license') THEN chr(10) || 'tags: legal' ELSE '' END || chr(10) || text) AS digest FROM documents")
def vector_document_text(spark, d):
    tag = F.when(T.contains_fold(F.col("text"), "license"), "tags: legal")
    return S.raw(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("\n", F.concat(F.lit("title: "), "source"), F.concat(F.lit("lang: "), "lang"), tag, "text"), 256).alias("digest"))


@query("bm25_exact", f"SELECT doc_id, round(score, 6) AS score FROM {bm25_sql('documents', {'text': 1.0, 'source': 1.0})} s ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def bm25_exact(spark, d):
    """By the kept index: only rows that have all trigrams are read for the phrase, and lengths come from the index."""
    docs = S.raw(spark, d, "documents").select("doc_id", "text", "source")
    s = L.bm25_indexed(index_of(spark, d), docs, PHRASE, {"text": 1.0, "source": 1.0})
    return s.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("bm25_weighted_chunk", f"SELECT doc_id, chunk_index, round(score, 6) AS score, CASE WHEN contains(lower(source), '{PHRASE}') THEN 0 WHEN contains(lower(chunk), '{PHRASE}') THEN 1 ELSE 2 END AS tier FROM {bm25_sql(CHUNKS + ' k', {'chunk': 1.0, 'source': 3.5})} s ORDER BY round(score, 6) DESC, tier, doc_id, chunk_index LIMIT 50")
def bm25_weighted_chunk(spark, d):
    c = L.fixed_chunks(S.raw(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", "text").select("doc_id", "source", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")
    s = L.bm25(c, PHRASE, {"chunk": 1.0, "source": 3.5})
    s = s.select("doc_id", "chunk_index", F.round("score", 6).alias("score"), L.title_tier(F.col("source"), F.col("chunk"), PHRASE).alias("tier"))
    return s.orderBy(F.desc("score"), "tier", "doc_id", "chunk_index").limit(50)


@query("term_and_fallback", """WITH p AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'no such phrase here')),
 t AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'scum') AND contains(lower(text), 'was'))
 SELECT doc_id FROM p UNION ALL SELECT doc_id FROM t WHERE NOT EXISTS (SELECT 1 FROM p)""")
def term_and_fallback(spark, d):
    docs = S.raw(spark, d, "documents")
    first = docs.filter(T.contains_fold(F.col("text"), "no such phrase here")).select("doc_id")
    return L.with_fallback(first, L.all_terms(docs, ["the", "scum", "was"], ["text"]).select("doc_id"))


def index_of(spark, d):
    """The kept index of documents, made where there is none."""
    return kept_index("documents", S.raw(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", ["text", "source"])


@query("trigram_postings", f"SELECT doc_id FROM documents WHERE contains(lower(text), 'heonan')")
def trigram_postings(spark, d):
    docs = S.raw(spark, d, "documents").select("doc_id", "text", "source")
    return index_of(spark, d).narrowed(docs, ["heonan"]).filter(T.contains_fold(F.col("text"), "heonan")).select("doc_id")


@query("multisource_search", """SELECT 'document' AS family, doc_id AS id FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT 'page', page_id FROM pages WHERE contains(lower(html), 'license')""")
def multisource_search(spark, d):
    a = S.raw(spark, d, "documents").filter(T.contains_fold(F.col("text"), "license")).select(F.lit("document").alias("family"), F.col("doc_id").alias("id"))
    return a.unionByName(S.raw(spark, d, "pages").filter(T.contains_fold(F.col("html"), "license")).select(F.lit("page").alias("family"), F.col("page_id").alias("id")))


ROUTES = f"""e AS (SELECT doc_id AS key, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank, 'exact' AS route FROM {bm25_sql('documents', {'text': 1.0, 'source': 1.0})} s QUALIFY rank <= 30),
 c AS (SELECT key, row_number() OVER (ORDER BY sc DESC, tier, key) AS rank, 'evidence' AS route FROM (SELECT doc_id AS key, round(max(score), 6) AS sc, min(CASE WHEN contains(lower(source), '{PHRASE}') THEN 0 WHEN contains(lower(chunk), '{PHRASE}') THEN 1 ELSE 2 END) AS tier FROM {bm25_sql(CHUNKS + ' k', {'chunk': 1.0, 'source': 3.5})} s GROUP BY doc_id) g QUALIFY rank <= 30),
 t AS (SELECT doc_id AS key, row_number() OVER (ORDER BY doc_id) AS rank, 'fts' AS route FROM documents WHERE contains(lower(text || ' ' || source), 'the') AND contains(lower(text || ' ' || source), 'and') QUALIFY rank <= 30),
 r AS (SELECT * FROM e UNION ALL SELECT * FROM c UNION ALL SELECT * FROM t)"""


def routes(spark, d):
    docs = S.evidence_documents(spark, d).withColumn("key", F.col("doc_id"))
    e = R.route(L.bm25(docs, PHRASE, {"content": 1.0, "title": 1.0}).withColumn("score", F.round("score", 6)), "exact", [F.desc("score"), F.asc("key")], 30)
    ch = L.bm25(L.fixed_chunks(docs.select("key", "content", "title"), "key", "content").select("key", "chunk", "title"), PHRASE, {"chunk": 1.0, "title": 3.5})
    best = ch.withColumn("tier", L.title_tier(F.col("title"), F.col("chunk"), PHRASE)).groupBy("key").agg(F.round(F.max("score"), 6).alias("score"), F.min("tier").alias("tier"))
    c = R.route(best, "evidence", [F.desc("score"), F.asc("tier"), F.asc("key")], 30)
    t = R.route(L.all_terms(docs, ["the", "and"], ["content", "title"]).select("key"), "fts", [F.asc("key")], 30)
    return e.unionByName(c).unionByName(t)


@query("fuse_weighted", f"WITH {ROUTES} SELECT key, round(sum(CASE route WHEN 'exact' THEN 2.0 WHEN 'evidence' THEN 10.0 ELSE 4.0 END - 0.01 * (rank - 1)), 6) AS score, count(*) AS routes FROM r GROUP BY key")
def fuse_weighted(spark, d):
    f = R.fuse_weighted(routes(spark, d), {"exact": 2.0, "evidence": 10.0, "fts": 4.0})
    return f.select("key", F.round("score", 6).alias("score"), F.size("paths").cast("long").alias("routes"))


@query("fuse_rrf", f"WITH {ROUTES} SELECT key, round(sum(CASE route WHEN 'exact' THEN 2.0 WHEN 'evidence' THEN 10.0 ELSE 4.0 END / (60 + rank)), 9) AS score, array_to_string(list_sort(list(route)), ',') AS paths FROM r GROUP BY key")
def fuse_rrf(spark, d):
    f = R.fuse_rrf(routes(spark, d), {"exact": 2.0, "evidence": 10.0, "fts": 4.0})
    return f.select("key", F.round("score", 9).alias("score"), F.concat_ws(",", "paths").alias("paths"))


FEATURES = f"""CASE WHEN contains(lower(text || ' ' || source), '{PHRASE}') THEN 6.0 ELSE 0.0 END + CASE WHEN contains(lower(source), '{PHRASE}') THEN 2.5 WHEN contains(lower(text), '{PHRASE}') THEN 0.75 ELSE 0.0 END
 + CASE WHEN contains(lower(text || ' ' || source), 'the') THEN 1.25 ELSE 0.0 END + CASE WHEN contains(lower(text || ' ' || source), 'and') THEN 1.25 ELSE 0.0 END
 + CASE WHEN list_contains(p, 'exact') THEN 1.0 ELSE 0.0 END + CASE WHEN list_contains(p, 'evidence') THEN 0.8 ELSE 0.0 END"""
HYBRID = f"""WITH {ROUTES}, f AS (SELECT key, round(sum(CASE route WHEN 'exact' THEN 2.0 WHEN 'evidence' THEN 10.0 ELSE 4.0 END / (60 + rank)), 9) AS fused, list_sort(list(route)) AS p FROM r GROUP BY key),
 g AS (SELECT f.*, text, source, CASE WHEN row_number() OVER (ORDER BY fused DESC, key) <= 50 THEN 0 ELSE 1 END AS tier FROM f JOIN documents ON doc_id = key),
 h AS (SELECT key, tier, text, p, CAST(fused + CASE WHEN tier = 0 THEN {FEATURES} ELSE 0 END AS DOUBLE) AS score FROM g)"""


@query("feature_rerank", f"{HYBRID} SELECT key AS doc_id, tier, round(score, 6) AS score FROM h")
def feature_rerank(spark, d):
    docs = S.evidence_documents(spark, d).select(F.col("doc_id").alias("key"), "content", "title")
    fused = R.fuse_rrf(routes(spark, d), {"exact": 2.0, "evidence": 10.0, "fts": 4.0}).withColumn("score", F.round("score", 9))
    fused = docs.join(F.broadcast(fused), "key")  # 90 rows at most
    out = R.rerank_head(fused, F.col("score") + R.feature_score(F.col("content"), F.col("title"), PHRASE, ["the", "and"], [], F.col("paths")), 50)
    return out.select(F.col("key").alias("doc_id"), "tier", F.round("score", 6).alias("score"))


@query("priority_dedupe", """SELECT key, family FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pr) AS n FROM (SELECT doc_id AS key, 'labels' AS family, 0 AS pr FROM labels UNION ALL SELECT doc_id, 'documents', 1 FROM documents UNION ALL SELECT page_id, 'pages', 2 FROM pages) u) t WHERE n = 1""")
def priority_dedupe(spark, d):
    parts = [S.raw(spark, d, t).select(F.col(k).alias("key"), F.lit(t).alias("family"), F.lit(i).alias("pr")) for i, (t, k) in enumerate((("labels", "doc_id"), ("documents", "doc_id"), ("pages", "page_id")))]
    return W.first_by(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["key"], F.asc("pr")).select("key", "family")


@query("dedupe_keep_greatest", f"SELECT digest, count(*) AS copies, max(doc_id) FILTER (WHERE n_chars = longest) AS kept FROM (SELECT *, max(n_chars) OVER (PARTITION BY digest) AS longest FROM (SELECT doc_id, n_chars, sha256(lower({NORM})) AS digest FROM documents) a) b GROUP BY digest")
def dedupe_keep_greatest(spark, d):
    docs = S.raw(spark, d, "documents").select("doc_id", "n_chars", F.sha2(F.lower(T.normalize_text(F.col("text"))), 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("copies"), F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("kept"))


@query("coverage_by_kind", "SELECT lang, count(*) AS total, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS gaps, round(count(l.doc_id) * 1.0 / count(*), 6) AS ratio FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY lang")
def coverage_by_kind(spark, d):
    lab = S.raw(spark, d, "labels").select("doc_id", F.lit(1).alias("has")).distinct()
    j = S.raw(spark, d, "documents").select("doc_id", "lang").join(lab, "doc_id", "left")
    n = F.count("has")
    return j.groupBy("lang").agg(F.count("*").alias("total"), n.alias("labelled"), (F.count("*") - n).alias("gaps"), F.round(n / F.count("*"), 6).alias("ratio"))


@query("prefix_join", f"SELECT l.doc_id, count(*) AS chunks FROM (SELECT 'doc/' || doc_id || '#chunk-' || chunk_index AS citation FROM {CHUNKS} c) k JOIN labels l ON split_part(k.citation, '#', 1) = 'doc/' || l.doc_id WHERE l.quality = 0 GROUP BY l.doc_id")
def prefix_join(spark, d):
    c = L.fixed_chunks(S.raw(spark, d, "documents"), "doc_id", "text").select(F.substring_index(F.concat(F.lit("doc/"), "citation"), "#", 1).alias("parent"))
    lab = S.raw(spark, d, "labels").filter("quality = 0").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("parent"))
    return c.join(lab, "parent").groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("keyset_page", "SELECT doc_id, lang FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 100")
def keyset_page(spark, d):
    from ..operators.filters import page_after

    return page_after(S.raw(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100, 100)


@query("percentile_nearest_rank", "SELECT lang, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars) AS BIGINT) AS p50, CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars) AS BIGINT) AS p95 FROM documents GROUP BY lang")
def percentile_nearest_rank(spark, d):
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by n_chars)").cast("long")
    return S.raw(spark, d, "documents").groupBy("lang").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
