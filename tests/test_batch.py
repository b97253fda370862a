"""Batch search against plain Python, and a grid that stops and goes on."""

import math
import re

import pytest
from pyspark.sql import functions as F

from evidara.operators.store import Store
from evidara.plans import batch

DOCS = [(1, "Alpha beta gamma. beta gamma delta"), (2, "alpha BETA"), (3, None), (4, ""), (5, "beta alpha beta alpha beta"), (6, "x " * 900 + "alpha beta"), (7, "alpha beta"), (8, "gamma delta gamma")]
CASES = [(1, "alpha beta"), (2, "gamma delta"), (3, "alpha nowhere"), (4, None), (5, "..."), (6, "beta alpha beta")]


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def count(ws, q):
    n = i = 0
    while i + len(q) <= len(ws):
        hit = ws[i : i + len(q)] == q
        n, i = n + hit, i + (len(q) if hit else 1)
    return n


def bm25(hits, sizes):
    mean, n = sum(sizes.values()) / len(sizes), len(sizes)
    idf = max(math.log((n - len(hits) + 0.5) / (len(hits) + 0.5)), 1e-6)
    score = {k: round(idf * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * sizes[k] / mean)), 6) for k, t in hits.items()}
    return sorted(score, key=lambda k: (-score[k], k))


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(DOCS, "key long, text string")
    cases = spark.createDataFrame(CASES, "case_id long, query string")
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k, _ in DOCS], "key long, vector array<double>")
    asked = spark.createDataFrame([(c, [float(c), 1.0]) for c, _ in CASES], "case_id long, q array<double>")
    return batch.BatchSearch(docs, cases, batch.corpus_sizes(docs), vectors, asked, limit=3)


def got(engine, mode):
    out = {}
    for r in engine.results(mode).orderBy("case_id", "rank").collect():
        out.setdefault(r.case_id, []).append(r.key)
        assert len(out[r.case_id]) == r["rank"]
    return out


def lists():
    sizes = {k: len(words(t)) for k, t in DOCS}
    exact, fts = {}, {}
    for c, q in CASES:
        q = words(q)
        hits = {k: count(words(t), q) for k, t in DOCS if q and count(words(t), q)}
        exact[c] = bm25(hits, sizes)
        df = {w: sum(w in words(t) for _, t in DOCS) for w in set(q)}
        order = list(exact[c])
        for w in sorted((w for w in df if df[w]), key=lambda w: (df[w], w))[:2]:
            order += bm25({k: words(t).count(w) for k, t in DOCS if w in words(t)}, sizes)
        fts[c] = list(dict.fromkeys(order))
    return exact, fts


def test_exact_and_fts_equal_plain_python(engine):
    exact, fts = lists()
    assert got(engine, "exact") == {c: k[:3] for c, k in exact.items() if k}
    assert got(engine, "fts") == {c: k[:3] for c, k in fts.items() if k}
    assert exact[6] == [5] and exact[3] == exact[4] == exact[5] == []


def test_chunks_find_what_is_far_into_a_text(engine):
    found = got(engine, "parent_child")
    assert set(found) == {1, 2, 6} and found[6] == [5]
    assert {r.key for r in engine.evidence.filter("case_id = 1").collect()} == {1, 2, 5, 6, 7}


def test_fusion_and_rerank(engine):
    near = {c: [k for k in sorted((k for k, _ in DOCS), key=lambda k: (-round((k * c + 1) / math.sqrt((k * k + 1) * (c * c + 1)), 9), k))] for c, _ in CASES}
    assert got(engine, "vector") == {c: k[:3] for c, k in near.items()}
    exact, fts = lists()
    chunks = {}
    for r in engine.evidence.orderBy("case_id", "rank").collect():
        chunks.setdefault(r.case_id, []).append(r.key)

    def fused(c, weights):
        s = {}
        for w, r in zip(weights, (exact[c], chunks.get(c, []), near[c], fts[c])):
            for i, k in enumerate(r, 1):
                s[k] = s.get(k, 0) + w / (60 + i)
        s = {k: round(x, 9) for k, x in s.items() if x}
        return s, sorted(s, key=lambda k: (-s[k], k))

    for mode, weights in (("hybrid-weighted", (2, 10, 1, 4)), ("hybrid-rrf", (1, 1, 1, 1)), ("vector-unavailable", (2, 10, 0, 4))):
        assert got(engine, mode) == {c: fused(c, weights)[1][:3] for c, _ in CASES if fused(c, weights)[1]}, mode
    texts, queries = {k: words(t) for k, t in DOCS}, {c: words(q) for c, q in CASES}
    for c, keys in got(engine, "feature-rerank").items():
        s, _ = fused(c, (2, 10, 1, 4))
        score = {k: round(x + 6.75 * (k in exact[c]) + 1.25 * len(set(queries[c]) & set(texts[k])) + (k in exact[c]) + 0.8 * (k in chunks.get(c, [])) + 0.4 * (k in near[c]), 6) for k, x in s.items()}
        assert keys == sorted(score, key=lambda k: (-score[k], k))[:3]


def test_no_documents_no_cases_no_vectors(spark, engine):
    none = engine.docs.limit(0)
    empty = batch.BatchSearch(none, spark.createDataFrame(CASES, "case_id long, query string"), batch.corpus_sizes(none))
    assert got(empty, "exact") == got(empty, "parent_child") == got(empty, "fts") == got(empty, "vector-unavailable") == {}
    idle = batch.BatchSearch(engine.docs, spark.createDataFrame([], "case_id long, query string"), engine.sizes)
    assert got(idle, "exact") == got(idle, "vector-unavailable") == {}
    with pytest.raises(ValueError):
        idle.results("vector")
    with pytest.raises(ValueError):
        idle.results("other")


def test_a_grid_goes_on_where_it_stopped(spark, engine, tmp_path):
    modes = ["exact", "fts"]
    cases = spark.createDataFrame(CASES, "case_id long, query string")
    expected = spark.createDataFrame([(1, 7), (2, 8), (3, 1)], "case_id long, key long")
    ran = []

    def search(part):
        ran.append(sorted(r.case_id for r in part.collect()))
        return batch.BatchSearch(engine.docs, part, engine.sizes, limit=3)

    def rows(grid):
        return sorted(tuple(r) for r in grid.measures().select("mode", "case_id", "expected", "hits", F.round("ndcg", 6)).collect())

    whole = batch.Grid(Store(spark, str(tmp_path / "whole")), cases, blocks=3)
    every = whole.run(modes, search, batch.measured(expected))
    grid = batch.Grid(Store(spark, str(tmp_path / "parts")), cases, blocks=3)
    assert grid.run(modes, search, batch.measured(expected), at_most=1) == every[:1]
    assert grid.missing(modes) == every[1:] and grid.run(modes, search, batch.measured(expected)) == every[1:]
    assert rows(grid) == rows(whole) and len(rows(whole)) == len(modes) * len(CASES)
    n, version = len(ran), grid.store.version().number
    assert grid.run(modes, search, batch.measured(expected)) == [] and len(ran) == n and grid.store.version().number == version
    changed = spark.createDataFrame([(c, q) for c, q in CASES if c != 4][:-1] + [(6, "gamma")], "case_id long, query string")
    again = batch.Grid(grid.store, changed, blocks=3)
    redone = again.run(modes, search, batch.measured(expected))
    assert {b for b, _ in redone} < {b for b, _ in every} or len(redone) == len(every)
    fresh = batch.Grid(Store(spark, str(tmp_path / "fresh")), changed, blocks=3)
    fresh.run(modes, search, batch.measured(expected))
    assert rows(again) == rows(fresh)


def test_parts_share_the_words_and_hits_of_all_cases(spark, engine):
    """Of worded documents a part of the cases gives what an engine of its own gives, from tables that were made once."""
    from evidara.operators import lookup as K

    docs = K.worded(engine.docs)
    assert docs.columns == ["key", "words"]
    cases = spark.createDataFrame(CASES, "case_id long, query string")
    table = K.term_table(docs, cases.withColumnRenamed("query", "text"))
    whole = batch.BatchSearch(docs, cases, batch.corpus_sizes(docs), engine.vectors, engine.query_vectors, limit=3, table=table)
    part = whole.part(cases.filter("case_id IN (1, 6)"))
    assert part.table is table
    for mode in batch.MODES:
        assert got(part, mode) == {c: keys for c, keys in got(engine, mode).items() if c in (1, 6)}, mode


def test_measures_cut_the_words_of_documents_once(spark):
    """The parts of an evaluation read the words of documents, not their texts."""
    from evidara.catalog.evaluation import Evaluated

    e = Evaluated(spark, "/root/testdata/sf0.001")
    assert e.docs.columns == ["key", "words"] and e.terms(2).columns == ["case_id", "key", "score", "rank"]
