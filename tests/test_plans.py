"""Physical plans: what reaches the scans, and what is not shuffled or multiplied."""

import re

import pytest
from pyspark.sql import functions as F

from evidara.operators import joins, lexical
from evidara.operators.lexical_index import kept_index
from evidara.queries import QUERIES
from evidara.sources import tables as S

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith("stream")))
def test_no_cartesian_product_and_no_row_udf(spark, name):
    p = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in p and "BatchEvalPython" not in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(QUERIES["filter_builder_since_until"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[.*EqualTo\(event_type,click\)", p) and re.search(r"GreaterThanOrEqual\(ts", p)
    assert "props" not in re.search(r"ReadSchema: (.*)", p)[1]
    p = plan(S.messages(spark, FOLDER).filter("conversation_id = 3").select("citation"))
    assert "EqualTo(conv_id,3)" in p and "text" not in re.search(r"ReadSchema: (.*)", p)[1]


def test_a_search_prunes_the_index_and_looks_citations_up_by_key(spark):
    docs = S.raw(spark, FOLDER, "documents").select("doc_id", "text", "source")
    p = plan(kept_index("documents", docs, "doc_id", ["text", "source"]).candidates("heonan"))
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(", p) and re.search(r"PushedFilters: \[.*In\(gram", p)
    p = plan(QUERIES["evidence_lookup"](spark, FOLDER))
    assert p.count("FileScan") == 4 and p.count("PushedFilters: []") == 0 and "In(conv_id" in p or "EqualTo(conv_id" in p
    p = plan(S.evidence(spark, FOLDER, ["doc/1", "doc/2#chunk-3"]))
    assert re.search(r"PushedFilters: \[.*In\(doc_id, \[1,2\]", p)


def test_an_or_join_is_made_of_equi_joins(spark):
    li = S.raw(spark, FOLDER, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    p = plan(joins.either_key(li, S.raw(spark, FOLDER, "supplier").select("s_suppkey"), ["l_suppkey", "l_partkey"], "s_suppkey", ["l_orderkey", "l_linenumber", "s_suppkey"]))
    assert "NestedLoop" not in p


def test_postings_are_cut_to_the_asked_grams(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (2, "xbcd"), (3, None), (4, "ab"), (5, "")], "doc_id long, text string")
    got = sorted(map(tuple, lexical.trigram_postings(docs, "doc_id", "text", ["abc", "bcd"]).collect()))
    assert got == [(1, "abc"), (2, "bcd")]
    every = lexical.trigram_postings(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert {r.doc_id: r.n for r in every.collect()} == {1: 3, 2: 2}
