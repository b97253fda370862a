"""The store in cells against a full scan, on clustered vectors and on ones without structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.operators import vector_store
from evidara.operators.store import Store
from evidara.operators.vector_store import VectorStore

ROWS = "key long, content_hash string, vector array<double>, label int"


def clustered(n=400, dims=8, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims))
    x = centers[np.arange(n) % groups] + 0.05 * rng.normal(size=(n, dims))
    x *= rng.uniform(0.2, 3, (n, 1))
    x[5] = 0
    return x


def table(spark, x, keys=None):
    keys = range(len(x)) if keys is None else keys
    return spark.createDataFrame([(int(k), str(v.tobytes().hex()), v.tolist(), int(k) % 3) for k, v in zip(keys, x)], ROWS)


def brute(rows, q, k, metric, floor=None):
    """rows: {key: vector}."""
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    score = lambda v: round(float(v @ q if metric == "inner" else unit(v) @ unit(q)), 9)
    found = sorted(((-score(v), i) for i, v in rows.items()))
    return [(i, -s) for s, i in found if floor is None or -s >= floor][:k]


def result(found):
    out = {}
    for r in sorted(found.rows.collect(), key=lambda r: (r.query, r["rank"])):
        out.setdefault(r.query, []).append((r.key, r.score))
    return out


def same(got, want):
    return {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()} and all(
        abs(a[1] - b[1]) < 1e-8 for q in got for a, b in zip(got[q], want[q])
    )


@pytest.mark.parametrize("metric", ["cosine", "inner"])
def test_equals_a_full_scan_and_reads_few_cells(spark, tmp_path, metric):
    x = clustered()
    store = VectorStore(Store(spark, str(tmp_path)))
    store.build(table(spark, x), cells=24)
    queries = {0: x[0], 1: x[7], 2: -x[3], 3: np.ones(8)}
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries.items()], "query long, q array<double>")
    found = store.search(q, 6, metric)
    rows = dict(enumerate(x))
    assert same(result(found), {i: brute(rows, v, 6, metric) for i, v in queries.items()})
    one = store.search(q.filter("query = 0"), 6, metric)
    assert one.cells >= 12 and one.cells_read <= one.cells // (4 if metric == "cosine" else 2)
    of_label = {i: v for i, v in rows.items() if i % 3 == 1}
    got = result(store.search(q, 200, metric, where=F.col("label") == 1, floor=0.3))
    assert same(got, {i: w for i, v in queries.items() if (w := brute(of_label, v, 200, metric, 0.3))})


def test_vectors_without_structure(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_store, "BLOCK", 2)
    x = np.random.default_rng(3).normal(size=(150, 5))
    store = VectorStore(Store(spark, str(tmp_path)))
    store.build(table(spark, x), cells=10)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "query long, q array<double>")
    assert same(result(store.search(q, 7)), {i: brute(dict(enumerate(x)), x[i], 7, "cosine") for i in range(5)})


def test_deltas_equal_a_full_scan_and_write_their_cells(spark, tmp_path):
    x = clustered(seed=4)
    store = VectorStore(Store(spark, str(tmp_path)))
    store.build(table(spark, x), cells=12)
    rows = dict(enumerate(x))
    rng = np.random.default_rng(9)
    q = spark.createDataFrame([(0, x[0].tolist()), (1, x[2].tolist())], "query long, q array<double>")
    for step in range(4):
        near = x[step] * rng.uniform(0.5, 2)
        puts = {int(k): near + 0.01 * rng.normal(size=8) for k in rng.choice(500, 5, replace=False)}
        gone = [int(k) for k in rng.choice(list(rows), 3, replace=False) if k not in puts]
        done = store.apply(table(spark, np.array(list(puts.values())), list(puts)), spark.createDataFrame([(k,) for k in gone], "key long"), once=("feed", step))
        assert done.counts["ledger"].get("deleted", 0) == len(gone) and len(done.written["vectors"]) <= 2 * len(puts) + len(gone)
        rows = {**{k: v for k, v in rows.items() if k not in gone}, **puts}
        assert store.apply(table(spark, np.array(list(puts.values())), list(puts)), once=("feed", step)).written == {}
    for metric in ("cosine", "inner"):
        assert same(result(store.search(q, 9, metric)), {0: brute(rows, x[0], 9, metric), 1: brute(rows, x[2], 9, metric)})
    v = store.store.version()
    assert v.read("vectors").count() == v.read("ledger").count() == len(rows) == v.read("cells").agg(F.sum("n")).first()[0]


def test_readers_keep_their_version_while_it_is_built_anew(spark, tmp_path):
    x = clustered()
    store = VectorStore(Store(spark, str(tmp_path)))
    store.build(table(spark, x), cells=8)
    pinned = store.store.version()
    store.build(table(spark, -x[:40]), cells=3)
    q = spark.createDataFrame([(0, x[0].tolist())], "query long, q array<double>")
    assert same(result(store.search(q, 5, version=pinned)), {0: brute(dict(enumerate(x)), x[0], 5, "cosine")})
    assert same(result(store.search(q, 5)), {0: brute(dict(enumerate(-x[:40])), x[0], 5, "cosine")})


def test_what_is_no_vector_is_an_error(spark, tmp_path):
    store = VectorStore(Store(spark, str(tmp_path)))
    with pytest.raises(Exception, match="finite"):
        store.build(table(spark, np.array([[1.0, float("nan")]])))
    with pytest.raises(Exception, match="as many"):
        store.build(spark.createDataFrame([(1, "a", [1.0, 2.0], 0), (2, "b", [1.0], 0)], ROWS))
    with pytest.raises(ValueError):
        store.apply(table(spark, np.ones((1, 2))))
    store.build(table(spark, np.ones((3, 2))))
    with pytest.raises(ValueError, match="finite"):
        store.search(spark.createDataFrame([(1, [1.0, float("inf")])], "query long, q array<double>"), 3)
    with pytest.raises(Exception, match="must all have"):
        store.search(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query long, q array<double>"), 3).rows.count()
    assert store.search(spark.createDataFrame([], "query long, q array<double>"), 3).rows.count() == 0


def test_an_empty_store_finds_nothing(spark, tmp_path):
    store = VectorStore(Store(spark, str(tmp_path)))
    store.build(spark.createDataFrame([], ROWS))
    assert store.search(spark.createDataFrame([(1, [1.0, 2.0])], "query long, q array<double>"), 3).rows.count() == 0
