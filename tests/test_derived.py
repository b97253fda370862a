"""Tables that are kept in step against tables made from nothing."""

import random

import pytest

from evidara.operators.derived import PARENT, TABLES, Derived
from evidara.operators.store import Change, Store, names_in
from evidara.sources.scratch import shared_place, shared_root


def parent(rnd, i):
    talk = f"t{i % 4}" if i % 3 else None
    words = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(rnd.choice([0, 3, 40, 400])))
    return (f"p/{i}", "message" if talk else "document", talk, i if talk else None, f"a{i % 2}", f"title {i}", rnd.choice([words, words, words, None]))


def rows_of(version, table):
    df = version.read(table)
    return None if df is None else sorted(map(repr, df.drop("cell").collect()))


def test_random_deltas_equal_a_rebuild(spark, tmp_path):
    rnd = random.Random(5)
    df = lambda rows: spark.createDataFrame(rows, PARENT)
    kept = Derived(Store(spark, str(tmp_path / "kept"), part_rows=20), cells=4)
    now = {}
    for step in range(5):
        size = 40 if step == 0 else 4
        puts = {i: parent(rnd, i) for i in rnd.sample(range(60), size)}
        gone = [i for i in rnd.sample(sorted(now), 3) if i not in puts] if now else []
        done = kept.apply(df(list(puts.values())), spark.createDataFrame([(f"p/{i}",) for i in gone], "citation string"), once=("feed", step))
        now = {**{i: r for i, r in now.items() if i not in gone}, **puts}
        if step:
            assert len(done.written.get("parents", [])) <= len(puts) + len(gone)
            assert sum(done.counts["chunks"].get(k, 0) for k in ("inserted", "changed", "deleted")) <= 5 * (len(puts) + len(gone))
        assert kept.apply(df(list(puts.values())), once=("feed", step)).written == {}
    v = kept.store.version()
    assert all(r.n == 0 for r in kept.orphans(v).collect())
    anew = Derived(Store(spark, str(tmp_path / "anew")), cells=4)
    anew.apply(df(list(now.values())))
    for table in TABLES:
        if table not in ("cells", "vectors"):
            assert rows_of(v, table) == rows_of(anew.store.version(), table), table
    assert sorted((r.key, r.vector) for r in v.read("vectors").collect()) == sorted((r.key, r.vector) for r in anew.store.version().read("vectors").collect())
    assert sorted(r.citation for r in kept.index(v).candidates("alpha").collect()) == sorted(i for i, *_, c in now.values() if c and "alpha" in c)

    before = {t: rows_of(v, t) for t in TABLES}
    kept.rebuild()
    after = kept.store.version()
    assert len(after.attached["lexical"]) == 1 and len(v.attached["lexical"]) > 1
    assert {t: rows_of(v, t) for t in TABLES if t != "cells"} == {t: rows_of(after, t) for t in TABLES if t != "cells"}
    assert before == {t: rows_of(v, t) for t in TABLES}  # who reads the older version sees it whole
    assert sorted(map(repr, kept.index(v).live().select("key").collect())) == sorted(map(repr, kept.index(after).live().select("key").collect()))
    assert kept.vacuum() > 1 and all(r.n == 0 for r in kept.orphans().collect())


def test_a_delta_that_fails_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    rnd = random.Random(6)
    kept = Derived(Store(spark, str(tmp_path)), cells=2)
    kept.apply(spark.createDataFrame([parent(rnd, i) for i in range(6)], PARENT))
    n = kept.store.version().number
    with monkeypatch.context() as m:
        m.setattr(Store, "_put", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            kept.apply(spark.createDataFrame([("p/3", "document", None, None, "a", "t", "quite another text")], PARENT))
    assert kept.store.version().number == n and all(r.n == 0 for r in kept.orphans().collect())
    assert kept.vacuum() >= 1


def test_a_commit_leaves_nothing_but_its_version(spark, tmp_path):
    """Neither what was settled on the way, nor keys of rows in each posting of the index."""
    rnd = random.Random(6)
    place = f"{shared_root(spark)}/evidara-core"
    shared_place(spark, "there-is-one")
    before = set(names_in(spark, place))
    kept = Derived(Store(spark, str(tmp_path / "kept")), cells=2)
    kept.apply(spark.createDataFrame([parent(rnd, i) for i in range(30)], PARENT))
    kept.apply(spark.createDataFrame([parent(rnd, i) for i in range(25, 35)], PARENT), spark.createDataFrame([("p/3",)], "citation string"))
    assert set(names_in(spark, place)) == before
    postings = kept.index()._read_postings()
    assert postings.filter("bucket < 64 and keys is not null").count() == 0 and postings.filter("bucket < 64").count() > 0


def test_orphans_of_each_kind_are_counted(spark, tmp_path):
    kept = Derived(Store(spark, str(tmp_path)), cells=2)
    rows = [(f"p/{i}", "message", "t", i, "a", "title", f"text {i} " * (200 if i == 3 else 1)) for i in range(6)]
    kept.apply(spark.createDataFrame(rows, PARENT))
    count = lambda: {r.kind: r.n for r in kept.orphans().collect()}
    assert set(count().values()) == {0}
    gone = lambda keys, schema: Change(deletes=spark.createDataFrame(keys, schema))
    kept.store.commit({"parents": gone([("p/1",)], "citation string")})
    assert count() == {"chunks": 1, "vectors": 0, "unembedded": 0, "episodes": 0, "indexed": 1, "unindexed": 0}
    kept.store.commit({"chunks": gone([("p/1", 0), ("p/2", 0)], "parent string, chunk_index long"), "ledger": gone([("p/3#chunk-1",)], "key string"), "timeline": gone([("t", f"p/{i}") for i in range(6)], "conversation string, citation string")})
    assert count() == {"chunks": 0, "vectors": 2, "unembedded": 1, "episodes": 2, "indexed": 1, "unindexed": 0}
