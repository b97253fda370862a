"""Queries of retrieval quality: the items of benchmark are cases, searched in all documents by several modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import latin_tokens
from ..operators import evaluation as V
from ..operators import lookup as K
from ..sources import tables as S
from ..sources.scratch import settled
from .registry import query

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def ranked_sql(most: int) -> str:
    """The best ten documents of each case by BM25 over its rarest words."""
    return f"""(SELECT case_id, key, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, key) AS rank FROM (
 SELECT case_id, tf.key, round(sum(greatest(ln((n - r.df + 0.5::DOUBLE) / (r.df + 0.5::DOUBLE)), 1e-6::DOUBLE) * c * 2.2::DOUBLE / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 6) AS score
 FROM tf JOIN (SELECT case_id, w, df FROM (SELECT case_id, df.w, df.df, row_number() OVER (PARTITION BY case_id ORDER BY df.df, df.w) AS i FROM cw JOIN df ON df.w = cw.w) x WHERE i <= {most}) r ON r.w = tf.w, (SELECT count(*) AS n, avg(len(ws)) AS mean FROM dw) st GROUP BY 1, 2) y QUALIFY rank <= 10)"""


FUSED = """(SELECT case_id, key, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, key) AS rank FROM (SELECT case_id, key, round(sum(c), 9) AS s FROM (SELECT case_id, key, 2.0::DOUBLE / (60 + rank) AS c FROM terms UNION ALL SELECT case_id, key, 1.0::DOUBLE / (60 + rank) FROM rare) x GROUP BY 1, 2) y QUALIFY rank <= 10)"""
BASE = f"""dw AS MATERIALIZED (SELECT doc_id AS key, lang, source, {WORDS.format("text")} AS ws FROM documents), bw AS MATERIALIZED (SELECT item_id AS case_id, {WORDS.format("text")} AS ws FROM benchmark),
 cw AS MATERIALIZED (SELECT DISTINCT case_id, w FROM (SELECT case_id, unnest(ws) AS w FROM bw) x), tf AS MATERIALIZED (SELECT key, size, w, count(*) AS c FROM (SELECT key, len(ws) AS size, unnest(ws) AS w FROM dw) x WHERE w IN (SELECT w FROM cw) GROUP BY 1, 2, 3),
 df AS MATERIALIZED (SELECT w, count(*) AS df FROM tf GROUP BY w), expected AS MATERIALIZED (SELECT case_id, key FROM bw JOIN dw ON contains(' ' || array_to_string(dw.ws, ' ') || ' ', ' ' || array_to_string(bw.ws, ' ') || ' ') WHERE len(bw.ws) > 0),
 terms AS MATERIALIZED {ranked_sql(8)}, rare AS MATERIALIZED {ranked_sql(2)}, fused AS MATERIALIZED {FUSED}"""


def per_case_sql(ranked: str) -> str:
    return f"""(SELECT b.case_id, b.case_id % 2 AS category, coalesce(ne, 0) AS expected, coalesce(nr, 0) AS returned, coalesce(h, 0) AS hits, CASE WHEN coalesce(h, 0) > 0 THEN 1.0 ELSE 0.0 END AS recall, coalesce(h, 0) / 10.0 AS "precision",
 coalesce(1.0 / f, 0.0) AS mrr, coalesce(ps, 0) / greatest(coalesce(ne, 0), coalesce(h, 0), 1) AS ap,
 coalesce(d3, 0) / list_sum(list_transform(range(1, least(greatest(coalesce(ne, 0), coalesce(h, 0), 1), 3) + 1), lambda i: 1 / log2(i + 1))) AS ndcg3, coalesce(d10, 0) / list_sum(list_transform(range(1, least(greatest(coalesce(ne, 0), coalesce(h, 0), 1), 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
 FROM bw b LEFT JOIN (SELECT case_id, count(*) AS ne FROM expected e GROUP BY 1) e ON e.case_id = b.case_id LEFT JOIN (SELECT case_id, count(*) AS nr, CAST(sum(rel) AS BIGINT) AS h, min(CASE WHEN rel = 1 THEN rank END) AS f, sum(CASE WHEN rel = 1 THEN so * 1.0 / rank ELSE 0 END) AS ps, sum(rel / log2(rank + 1)) AS d10, sum(CASE WHEN rank <= 3 THEN rel / log2(rank + 1) ELSE 0 END) AS d3
  FROM (SELECT *, sum(rel) OVER (PARTITION BY case_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so FROM (SELECT r.*, CASE WHEN x.key IS NULL THEN 0 ELSE 1 END AS rel FROM {ranked} r LEFT JOIN expected x ON x.case_id = r.case_id AND x.key = r.key) y) z GROUP BY 1) m ON m.case_id = b.case_id)"""


class Evaluated:
    """Cases, documents, expectations and the results of each mode; the words of documents are counted once."""

    def __init__(self, spark, d):
        self.cases = S.raw(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text")
        self.docs = K.worded(S.raw(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"))
        self.table = K.term_table(self.docs, self.cases)
        self.expected = settled(K.containing(self.docs, self.cases, self.table), "expected")

    def terms(self, most):
        return settled(K.ranked_by_terms(self.docs, self.table, K.rarest(self.cases, self.table, most), 10), "ranked")

    def per_case(self, results):
        return V.per_case(self.cases.select("case_id", (F.col("case_id") % 2).alias("category")), results, self.expected, 10)


@query("ir_metrics", f"WITH {BASE} SELECT case_id, expected, returned, hits, recall, round(\"precision\", 6) AS \"precision\", round(mrr, 6) AS mrr, round(ap, 6) AS ap, round(ndcg3, 6) AS ndcg3, round(ndcg, 6) AS ndcg FROM {per_case_sql('terms')} c")
def ir_metrics(spark, d):
    e = Evaluated(spark, d)
    return e.per_case(e.terms(8)).select("case_id", "expected", "returned", "hits", "recall", *(F.round(c, 6).alias(c) for c in ("precision", "mrr", "ap", "ndcg3", "ndcg")))


MEAN = lambda c: f"round(coalesce(avg(CASE WHEN expected > 0 THEN {c} END), 0), 6)"


def summary_sql(ranked: str) -> str:
    return f"(SELECT category, count(*) AS cases, count(*) FILTER (WHERE expected > 0) AS positive, {MEAN('recall')} AS recall, {MEAN(chr(34) + 'precision' + chr(34))} AS \"precision\", {MEAN('mrr')} AS mrr, {MEAN('ap')} AS map, round(avg(ndcg3), 6) AS ndcg3, round(avg(ndcg), 6) AS ndcg FROM {per_case_sql(ranked)} c GROUP BY category)"


@query("ir_metrics_by_category", f"WITH {BASE} SELECT * FROM {summary_sql('terms')} s")
def ir_metrics_by_category(spark, d):
    e = Evaluated(spark, d)
    return V.summary(e.per_case(e.terms(8)), ["category"])


@query("regression_gate", f"WITH {BASE} SELECT c.category, c.recall, c.ndcg, c.recall >= 0.5 AND c.ndcg >= 0.1 AND c.recall >= b.recall - 0.02 AND c.ndcg >= b.ndcg - 0.02 AS passed FROM {summary_sql('rare')} c JOIN {summary_sql('terms')} b ON b.category = c.category")
def regression_gate(spark, d):
    """A run with two words a case against the run with eight."""
    e = Evaluated(spark, d)
    base, other = (V.summary(e.per_case(e.terms(n)), ["category"]).select("category", "recall", "ndcg") for n in (8, 2))
    return V.gate(base, other, ["category"], {"recall": (0.5, 0.02), "ndcg": (0.1, 0.02)})


GRID = " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM {per_case_sql(m)} {m}_c" for m in ("terms", "rare", "fused"))


@query("eval_grid", f"WITH {BASE} SELECT mode, count(*) AS cases, {MEAN('recall')} AS recall, {MEAN('mrr')} AS mrr, {MEAN('ap')} AS map, round(avg(ndcg), 6) AS ndcg FROM ({GRID}) g GROUP BY mode")
def eval_grid(spark, d):
    """Every mode over every case, judged alike."""
    e = Evaluated(spark, d)
    terms, rare = e.terms(8), e.terms(2)
    out = None
    for mode, results in (("terms", terms), ("rare", rare), ("fused", K.fused([(2.0, terms), (1.0, rare)], 10))):
        m = e.per_case(results).withColumn("mode", F.lit(mode))
        out = m if out is None else out.unionByName(m)
    return V.summary(out, ["mode"]).select("mode", "cases", "recall", "mrr", "map", "ndcg")


#: What each case asks for: nothing where no document has it; all, one path, one language or one source by its number; every eighth forbids what would be expected.
FAILURES = f"""WITH {BASE}, x AS (SELECT case_id, key FROM expected WHERE case_id % 8 = 3), w AS (SELECT case_id, key FROM expected WHERE case_id % 8 <> 3),
 first AS (SELECT e.case_id, dw.source, dw.lang FROM (SELECT case_id, min(key) AS key FROM expected GROUP BY 1) e JOIN dw ON dw.key = e.key),
 k AS (SELECT bw.case_id, f.case_id IS NULL AS none_expected, bw.case_id % 4 = 1 AS all_expected, CASE WHEN bw.case_id % 5 = 0 THEN 'rare' END AS path, CASE WHEN bw.case_id % 3 = 0 THEN 'de' END AS family, CASE WHEN bw.case_id % 7 = 2 THEN 'src1' END AS context FROM bw LEFT JOIN first f ON f.case_id = bw.case_id),
 r AS (SELECT t.case_id, t.key, CASE WHEN y.key IS NULL THEN ['terms'] ELSE ['terms', 'rare'] END AS paths, dw.lang AS family, dw.source AS context FROM terms t JOIN dw ON dw.key = t.key LEFT JOIN rare y ON y.case_id = t.case_id AND y.key = t.key),
 g AS (SELECT k.*, (SELECT count(*) FROM r WHERE r.case_id = k.case_id) AS returned, (SELECT count(*) FROM w WHERE w.case_id = k.case_id) AS wanted, (SELECT count(*) FROM x WHERE x.case_id = k.case_id) AS excluded, (SELECT count(*) FROM r JOIN w ON w.case_id = r.case_id AND w.key = r.key WHERE r.case_id = k.case_id) AS matched,
  (SELECT count(*) FROM r JOIN x ON x.case_id = r.case_id AND x.key = r.key WHERE r.case_id = k.case_id) AS bad, EXISTS (SELECT 1 FROM r WHERE r.case_id = k.case_id AND list_contains(r.paths, k.path)) AS path_ok, EXISTS (SELECT 1 FROM r WHERE r.case_id = k.case_id AND r.family = k.family) AS family_ok, EXISTS (SELECT 1 FROM r WHERE r.case_id = k.case_id AND r.context = k.context) AS context_ok FROM k)
 SELECT case_id, CASE WHEN none_expected THEN CASE WHEN returned > 0 THEN 'negative_false_positive' ELSE 'ok' END WHEN bad > 0 THEN 'negative_excluded_citation_in_topk' WHEN excluded > 0 AND wanted = 0 THEN 'ok' WHEN returned = 0 THEN 'no_results' WHEN all_expected AND matched < wanted THEN 'expected_all_missing'
  WHEN wanted > 0 AND matched = 0 THEN 'expected_missing' WHEN path IS NOT NULL AND NOT path_ok THEN 'expected_retrieval_path_missing' WHEN family IS NOT NULL AND NOT family_ok THEN 'source_family_missing' WHEN context IS NOT NULL AND NOT context_ok THEN 'context_failed' ELSE 'ok' END AS failure FROM g"""


def judged_failures(spark, d):
    e = Evaluated(spark, d)
    terms, rare = e.terms(8), e.terms(2)
    about = S.raw(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("family"), F.col("source").alias("context"))
    found = terms.join(rare.select("case_id", "key", F.lit(True).alias("in_rare")), ["case_id", "key"], "left").join(about, "key")
    results = found.withColumn("paths", F.when(F.col("in_rare"), F.array(F.lit("terms"), F.lit("rare"))).otherwise(F.array(F.lit("terms"))))
    some = e.expected.select("case_id").distinct().withColumn("some", F.lit(True))
    i = F.col("case_id")
    cases = e.cases.join(some, "case_id", "left").select(
        "case_id", F.col("some").isNull().alias("none_expected"), (i % 4 == 1).alias("all_expected"), F.when(i % 5 == 0, "rare").alias("path"), F.when(i % 3 == 0, "de").alias("family"), F.when(i % 7 == 2, "src1").alias("context")
    )
    return V.failure_class(cases, results, e.expected.filter("case_id % 8 <> 3"), e.expected.filter("case_id % 8 = 3"))


@query("failure_of_cases", FAILURES)
def failure_of_cases(spark, d):
    return judged_failures(spark, d).select("case_id", "failure")


@query("failure_classes", f"SELECT failure, count(*) AS n FROM ({FAILURES}) f GROUP BY failure")
def failure_classes(spark, d):
    return judged_failures(spark, d).groupBy("failure").agg(F.count("*").alias("n"))


@query("pack_compat", f"WITH {BASE} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT case_id FROM expected e)")
def pack_compat(spark, d):
    e = Evaluated(spark, d)
    return e.cases.join(e.expected, "case_id", "left_anti").select(F.col("case_id").alias("item_id"))


@query("pack_quality", "SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS terms, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), ['the', 'and', 'of', 'der', 'les'])) * 1.0 / greatest(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))), 1), 6) AS common_ratio FROM benchmark")
def pack_quality(spark, d):
    t = latin_tokens(F.col("text"))
    common = F.array(*map(F.lit, ("the", "and", "of", "der", "les")))
    return S.raw(spark, d, "benchmark").select("item_id", F.size(t).cast("long").alias("terms"), F.round(F.size(F.array_intersect(t, common)) / F.greatest(F.size(t), F.lit(1)), 6).alias("common_ratio"))
