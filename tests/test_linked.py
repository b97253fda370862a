"""What follows from a batch of linked rows, and what does not when it comes again."""

import pytest

from evidara.operators.linked import ASSET, ENTITY, LINK, OBSERVATION, SOURCE_ROW, Link, MediaGraph, People, dangling, purge
from evidara.operators.store import Change, Store


@pytest.fixture
def graph(spark, tmp_path):
    return MediaGraph(Store(spark, str(tmp_path)))


def assets(spark, *rows):
    """(id, hash, cache, processing, placeholder)"""
    full = [(i, "me", "msg", "s", "voice", "amr", h, h and f"/{h}", c, p, ph, n) for n, (i, h, c, p, ph) in enumerate(rows)]
    return spark.createDataFrame(full, ASSET + ", placeholder boolean, ordinal int")


def links(spark, *rows):
    return spark.createDataFrame([(f"l-{a}", a, scope, True, "exact", "m", n) for n, (a, scope) in enumerate(rows)], LINK + ", ordinal int")


def state(graph, table, *columns):
    rows = graph.store.version().read(table)
    return sorted(tuple(r) for r in rows.select(*columns).collect()) if rows is not None else []


def test_voice_in_private_links_has_a_job(spark, graph):
    batch = assets(spark, ("a", "h1", "cached", "pending", False), ("b", "h2", "cached", "pending", False)), links(spark, ("a", "private_chat"), ("b", "group"))
    graph.upsert(*batch)
    assert state(graph, "jobs", "asset_id", "status") == [("a", "pending")]
    n = graph.store.version().number
    graph.upsert(*batch)
    assert graph.store.version().number == n  # a replay is no commit
    graph.upsert(assets(spark, ("a", "h1", "copied", "pending", False)), links(spark, ("a", "group")))
    assert state(graph, "jobs", "asset_id", "status", "error_code") == [("a", "skipped", "out_of_scope")]
    graph.upsert(assets(spark).limit(0), links(spark, ("a", "private_chat"), ("b", "private_chat")))
    assert state(graph, "jobs", "asset_id", "status", "error_code") == [("a", "pending", None), ("b", "pending", None)]


def test_known_content_keeps_its_id_and_its_links_follow(spark, graph):
    graph.upsert(assets(spark, ("a", "h1", "cached", "done", False)), links(spark, ("a", "group")))
    rows = spark.createDataFrame([("src", 1, "f", "z")], SOURCE_ROW)
    graph.upsert(assets(spark, ("z", "h1", "copied", "done", False)), links(spark, ("z", "private_chat")), rows)
    assert state(graph, "assets", "asset_id", "cache_state") == [("a", "copied")]
    assert state(graph, "links", "link_id", "asset_id") == [("l-a", "a"), ("l-z", "a")] and state(graph, "source_rows", "asset_id") == [("a",)]
    graph.upsert(assets(spark, ("a", None, "metadata_only", "pending", True)), links(spark).limit(0))
    assert state(graph, "assets", "content_hash", "cache_state", "processing_state") == [("h1", "copied", "done")]


def test_a_replay_of_copies_within_one_batch_writes_nothing(spark, graph):
    graph.upsert(assets(spark, ("m", "h0", "cached", "done", False), ("n", "h0", "cached", "done", False)), links(spark, ("m", "group"), ("n", "group")))
    batch = assets(spark, ("n", "h0", "copied", "pending", False), ("y", "h1", "copied", "pending", False), ("x", "h1", "copied", "pending", False)), links(spark, ("n", "group"), ("x", "group"), ("y", "private_chat"))
    graph.upsert(*batch)
    assert state(graph, "links", "link_id", "asset_id") == [("l-m", "m"), ("l-n", "m"), ("l-x", "x"), ("l-y", "y")]
    assert graph.upsert(*batch).written == {}


def test_assets_without_source_rows_are_stale(spark, graph):
    rows = lambda *r: spark.createDataFrame([("src", i, "f", a) for i, a in r], SOURCE_ROW)
    none = assets(spark).limit(0), links(spark).limit(0)
    graph.upsert(assets(spark, ("a", "h1", "cached", "pending", False), ("b", "h2", "cached", "pending", False)), links(spark, ("a", "private_chat"), ("b", "private_chat")), rows((1, "a"), (2, "a"), (3, "b")))
    graph.upsert(*none, dropped=rows((1, "a"), (3, "b")).select("source_key", "row_id"))
    assert state(graph, "assets", "asset_id", "processing_state") == [("a", "pending"), ("b", "stale")]
    assert state(graph, "links", "asset_id", "accepted", "reason") == [("a", True, "exact"), ("b", False, "source_deleted")]
    assert state(graph, "jobs", "asset_id", "status") == [("a", "pending"), ("b", "skipped")]


def test_identifiers_follow_entities_and_observations(spark, tmp_path):
    people = People(Store(spark, str(tmp_path)))
    e = lambda *rows: spark.createDataFrame([(i, "person", n, "active", 0.9) for i, n in rows], ENTITY)
    o = lambda *rows: spark.createDataFrame([(i, x, "Alias", v, s, 2.0, c) for i, x, v, s, c in rows], OBSERVATION)
    _, left = people.upsert(e(("p", "  Ann  LEE ")), o(("1", "p", "Annie", "active", "c1"), ("2", "nobody", "x", "active", "c2"), ("3", "p", "y", "active", ""), ("4", "p", "z", "odd", "c4"), ("5", "p", "Old", "retired", "c5")))
    assert left == 3
    got = lambda: sorted((r.identifier_type, r.normalized_value, r.confidence) for r in people.store.version().read("identifiers").collect())
    assert got() == [("alias", "annie", 1.0), ("display_name", "ann lee", 0.9)]
    people.upsert(e(("p", "Ann L")), o(("1", "p", "Annie", "superseded", "c1")))
    assert got() == [("display_name", "ann l", 0.9)]
    n = people.store.version().number
    people.upsert(e(("p", "Ann L")), o(("1", "p", "Annie", "superseded", "c1")))
    assert people.store.version().number == n


def test_a_purge_leaves_nothing_that_refers_to_what_went(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = lambda rows, schema: Change(spark.createDataFrame(rows, schema))
    tables = {
        "source": df([(1,), (2,)], "s long"),
        "run": df([(10, 1), (20, 2), (30, None)], "r long, s long"),
        "task": df([(100, 10, 2), (200, 20, 2), (300, 30, 1), (400, 30, 2)], "t long, r long, s long"),
        "note": df([(1000, 100), (2000, 200), (3000, 300), (4000, 400)], "n long, t long"),
    }
    store.commit(tables, {"source": ["s"], "run": ["r"], "task": ["t"], "note": ["n"]})
    graph = [Link("run", "s", "source"), Link("task", "r", "run"), Link("task", "s", "source"), Link("note", "t", "task")]
    keys = spark.createDataFrame([(1,), (7,)], "s long")
    purge(store, "p1", "source", keys, graph)
    v = store.version()
    assert [(r.table, r.removed) for r in v.read("audit").orderBy("step").collect()] == [("source", 1), ("run", 1), ("task", 2), ("note", 2)]
    assert sorted(r.n for r in v.read("note").collect()) == [2000, 4000] and all(r.n == 0 for r in dangling(v, graph).collect())
    assert purge(store, "p1", "source", spark.createDataFrame([(2,)], "s long"), graph).written == {} and store.version().number == v.number
