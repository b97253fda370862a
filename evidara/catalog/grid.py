"""Batch search and the grid of modes: the first two words of each item of benchmark are searched in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import evaluation as V
from ..operators import lookup as K
from ..operators.store import Store
from ..plans import batch
from ..sources import tables as S
from ..sources.scratch import settled, shared_place
from .evaluation import MEAN, WORDS, per_case_sql
from .registry import query
from .retrieval import bm25, hits

ASKED = 2


def ranked(name: str, by: str, order: str, source: str, n: int = 30) -> str:
    return f"{name} AS MATERIALIZED (SELECT {by}, key, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM {source} QUALIFY rank <= {n})"


def fused(name: str, routes: dict[str, float], n: int) -> str:
    parts = " UNION ALL ".join(f"SELECT case_id, key, {w}::DOUBLE / (60 + rank) AS c FROM {r}" for r, w in routes.items())
    return f"{name} AS MATERIALIZED (SELECT case_id, key, s, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, key) AS rank FROM (SELECT case_id, key, round(sum(c), 9) AS s FROM ({parts}) p GROUP BY 1, 2) x QUALIFY rank <= {n})"


#: Signed counts of characters and pairs of a text by the hash of each, as a unit vector of 32, rounded.
VECTORS = """t AS MATERIALIZED (SELECT 0 AS of_case, doc_id AS id, lower(coalesce(text, '')) AS t FROM documents UNION ALL SELECT 1, case_id, array_to_string(q, ' ') FROM bw),
 tk AS (SELECT of_case, id, token, count(*) AS c FROM (SELECT of_case, id, unnest(list_concat(list_transform(range(1, length(t) + 1), lambda i: substring(t, i, 1)), list_transform(range(1, length(t)), lambda i: substring(t, i, 2)))) AS token FROM t) x GROUP BY 1, 2, 3),
 th AS MATERIALIZED (SELECT token, CAST('0x' || substring(sha256(token), 1, 8) AS BIGINT) % 32 AS b, CASE WHEN substring(sha256(token), 10, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE -1 END AS s FROM (SELECT DISTINCT token FROM tk) x),
 tv AS (SELECT of_case, id, b, sum(c * s) AS x FROM tk JOIN th ON th.token = tk.token GROUP BY 1, 2, 3), tn AS (SELECT of_case, id, sqrt(sum(x * x)::DOUBLE) AS n FROM tv GROUP BY 1, 2),
 vec AS MATERIALIZED (SELECT t.of_case, t.id, list(round(coalesce(tv.x, 0)::DOUBLE / CASE WHEN coalesce(tn.n, 0) = 0 THEN 1 ELSE tn.n END, 6) ORDER BY d.i) AS v FROM t CROSS JOIN range(0, 32) d(i) LEFT JOIN tn ON tn.of_case = t.of_case AND tn.id = t.id LEFT JOIN tv ON tv.of_case = t.of_case AND tv.id = t.id AND tv.b = d.i GROUP BY 1, 2)"""
COSINE = "round(CASE WHEN list_inner_product(a.v, a.v) = 0 OR list_inner_product(b.v, b.v) = 0 THEN 0 ELSE list_inner_product(b.v, a.v) / (sqrt(list_inner_product(b.v, b.v)) * sqrt(list_inner_product(a.v, a.v))) END, 9)"
ALL = {"exact": 2.0, "parent_child": 10.0, "vector": 1.0, "fts": 4.0}
MODES_SQL = f"""dw AS MATERIALIZED (SELECT doc_id AS key, ws, ' ' || array_to_string(ws, '  ') || ' ' AS seq FROM (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents) x),
 bw AS MATERIALIZED (SELECT case_id, ws, list_slice(ws, 1, {ASKED}) AS q FROM (SELECT item_id AS case_id, {WORDS.format("coalesce(text, '')")} AS ws FROM benchmark) x),
 expected AS MATERIALIZED (SELECT case_id, key FROM bw JOIN dw ON contains(' ' || array_to_string(dw.ws, ' ') || ' ', ' ' || array_to_string(bw.ws, ' ') || ' ') WHERE len(bw.ws) > 0),
 cq AS (SELECT case_id, ' ' || array_to_string(q, '  ') || ' ' AS p FROM bw WHERE len(q) > 0), cw AS MATERIALIZED (SELECT DISTINCT case_id, w FROM (SELECT case_id, unnest(q) AS w FROM bw) x),
 tf AS MATERIALIZED (SELECT key, size, w, count(*) AS c FROM (SELECT key, len(ws) AS size, unnest(ws) AS w FROM dw) x WHERE w IN (SELECT w FROM cw) GROUP BY 1, 2, 3), df AS MATERIALIZED (SELECT w, count(*) AS df FROM tf GROUP BY w),
 dn AS (SELECT *, CAST(greatest(ceil((length(seq) - 120) / 780.0), 1) AS BIGINT) AS n FROM dw), st AS MATERIALIZED (SELECT count(*) AS n, avg(len(ws)) AS mean, sum(n) AS chunks, sum(length(seq) + (n - 1) * 120) / sum(n) AS chunk_mean FROM dn),
 hit AS MATERIALIZED (SELECT case_id, p, key, dn.n, seq, len(ws) AS size, {hits("seq")} AS tf FROM dn JOIN cq ON contains(seq, p)),
 hs AS (SELECT case_id, key, {bm25("st.n", "(count(*) OVER (PARTITION BY case_id))", "tf", "size", "mean")} AS score FROM hit, st),
 {ranked("exact", "case_id", "score DESC, key", "hs")},
 ck AS MATERIALIZED (SELECT case_id, key, k, length(piece) AS size, {hits("piece")} AS tf FROM (SELECT case_id, p, key, k, substring(seq, k * 780 + 1, 900) AS piece FROM (SELECT *, unnest(range(0, n)) AS k FROM hit) x) y),
 cs AS (SELECT case_id, key, k, {bm25("chunks", "(count(*) OVER (PARTITION BY case_id))", "tf", "size", "chunk_mean")} AS score FROM ck, st WHERE tf > 0),
 cr AS (SELECT case_id, key, min(r) AS o FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, key, k) AS r FROM cs QUALIFY r <= 30) x GROUP BY 1, 2), {ranked("parent_child", "case_id", "o", "cr")},
 rw AS (SELECT case_id, df.w, df.df, row_number() OVER (PARTITION BY case_id ORDER BY df.df, df.w) AS turn FROM cw JOIN df ON df.w = cw.w QUALIFY turn <= 2),
 ws AS (SELECT case_id, turn, tf.key, {bm25("st.n", "rw.df", "c", "size", "mean")} AS score FROM tf JOIN rw ON rw.w = tf.w, st), {ranked("wr", "case_id, turn", "score DESC, key", "ws")},
 ft AS (SELECT case_id, key, min(turn * 1000 + rank) AS o FROM (SELECT case_id, 0 AS turn, key, rank FROM exact UNION ALL SELECT case_id, turn, key, rank FROM wr) x GROUP BY 1, 2), {ranked("fts", "case_id", "o", "ft")},
 {VECTORS}, vs AS MATERIALIZED (SELECT a.id AS case_id, b.id AS key, {COSINE} AS score FROM vec a JOIN vec b ON a.of_case = 1 AND b.of_case = 0), {ranked("vector", "case_id", "score DESC, key", "vs")},
 {fused("weighted", ALL, 50)}, {fused("rrf", dict.fromkeys(ALL, 1.0), 10)}, {fused("lexical", {n: w for n, w in ALL.items() if n != "vector"}, 10)},
 fw AS (SELECT case_id, key, count(*) AS n FROM cw JOIN tf ON tf.w = cw.w GROUP BY 1, 2),
 fs AS (SELECT f.case_id, f.key, round(f.s + CASE WHEN hit.key IS NULL THEN 0 ELSE 6.75 END + 1.25 * coalesce(fw.n, 0) + CASE WHEN x.key IS NULL THEN 0 ELSE 1.0 END + CASE WHEN c.key IS NULL THEN 0 ELSE 0.8 END + CASE WHEN v.key IS NULL THEN 0 ELSE 0.4 END, 6) AS score
  FROM weighted f LEFT JOIN hit ON hit.case_id = f.case_id AND hit.key = f.key LEFT JOIN fw ON fw.case_id = f.case_id AND fw.key = f.key LEFT JOIN exact x ON x.case_id = f.case_id AND x.key = f.key LEFT JOIN parent_child c ON c.case_id = f.case_id AND c.key = f.key LEFT JOIN vector v ON v.case_id = f.case_id AND v.key = f.key),
 {ranked("reranked", "case_id", "score DESC, key", "fs")}"""
TABLES = {"exact": "exact", "fts": "fts", "parent_child": "parent_child", "vector": "vector", "hybrid-weighted": "weighted", "hybrid-rrf": "rrf", "vector-unavailable": "lexical", "feature-rerank": "reranked"}


class Asked:
    """The documents with their words and vectors, each made once, and the cases."""

    def __init__(self, spark, d):
        text = F.coalesce("text", F.lit(""))
        docs = S.raw(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
        self.docs = K.worded(docs)
        self.items = S.raw(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text")
        self.cases = settled(self.items.select("case_id", F.array_join(F.slice(K.words(F.col("text")), 1, ASKED), " ").alias("query")), "cases")
        self.table = K.term_table(self.docs, self.items)
        vectors = settled(docs.select("key", P.embedded(text).alias("vector")), "vectors")
        asked = settled(self.cases.select("case_id", P.embedded("query").alias("q")), "asked")
        self.engine = batch.BatchSearch(self.docs, self.cases, batch.corpus_sizes(self.docs), vectors, asked, table=self.table)


@query("batch_search", f"WITH {MODES_SQL} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, case_id, key, rank FROM {t} {t}_r WHERE rank <= 10" for m, t in TABLES.items()))
def batch_search(spark, d):
    """The first ten documents of every case, by every mode."""
    a = Asked(spark, d)
    out = None
    for mode in batch.MODES:
        rows = a.engine.results(mode).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


def top_ten(table: str) -> str:
    return per_case_sql(f"(SELECT * FROM {table} WHERE rank <= 10)")


@query("eval_modes", f"WITH {MODES_SQL} SELECT mode, count(*) AS cases, {MEAN('recall')} AS recall, {MEAN('mrr')} AS mrr, {MEAN('ap')} AS map, round(avg(ndcg), 6) AS ndcg FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM {top_ten(t)} {t}_c" for m, t in TABLES.items()) + ") g GROUP BY mode")
def eval_modes(spark, d):
    """Eight modes over all cases, in two blocks: a run that stops after three of its sixteen parts, and one that does the others."""
    a = Asked(spark, d)
    expected = settled(K.containing(a.docs, a.items, a.table), "expected")
    grid = batch.Grid(Store(spark, f"{shared_place(spark, 'grid')}/store"), a.cases, blocks=2)
    grid.run(batch.MODES, a.engine.part, batch.measured(expected), at_most=3)
    grid.run(batch.MODES, a.engine.part, batch.measured(expected))
    return V.summary(grid.measures(), ["mode"]).select("mode", "cases", "recall", "mrr", "map", "ndcg")
