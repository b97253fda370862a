"""Python functions over Arrow batches: a worker holds a slice of a batch as Python objects, not the batch."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from evidara.functions import parsing as P
from evidara.functions.slices import ROWS, cut, in_slices
from evidara.sources import timeline as M


def test_a_slice_goes_back_before_the_next():
    seen = []
    out = in_slices(lambda v: seen.append(v) or v, pa.int64())(iter([pa.array(range(ROWS * 3 + 1)), pa.array([], pa.int64()), pa.array([None, 7])]))
    assert len(next(out)) == ROWS and len(seen) == ROWS
    assert sum(len(a) for a in out) == ROWS * 2 + 3 and seen[-2:] == [None, 7]


def test_functions_of_columns_go_by_slices(spark):
    """Values as by the plain functions, nulls and the edges of slices included; and none of a batch is made at once."""
    for f in (M.parsed_timeline, P.chunk_text, P.embedded, P.parsed_page, P.parsed_item):
        assert len(next(f.func(iter([pa.array(["a text"] * 1000)])))) == ROWS
    xml = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, "<TimelineObject><id>").otherwise(
        F.concat(F.lit("<TimelineObject><id>"), "id", F.lit("</id><createTime>"), "id", F.lit("</createTime><feedKey>k</feedKey></TimelineObject>"))
    )
    rows = spark.range(0, 1000, 1, 2).withColumn("x", xml).select("id", "x", M.parsed_timeline("x").alias("p"), P.chunk_text("x").alias("c"), P.embedded("x").alias("e"), P.parsed_page("x").alias("h")).collect()
    assert len(rows) == 1000
    for r in rows:
        assert tuple(r.p) == M.parse_timeline(r.x) and r.c == P.chunk(r.x) and r.e == P.hash_embedding(r.x) and tuple(r.h) == P.parse_page(r.x)


def test_vectors_of_a_slice_are_those_of_each_text():
    """Worked out together, and of characters beyond those that are held in tables too."""
    rnd = random.Random(3)
    letters = [chr(rnd.choice([rnd.randrange(32, 0xD800), rnd.randrange(97, 123)])) for _ in range(3000)]
    texts = [None, "", "a", "ΑΣ Σ", "🙂é中文", *("a" * k for k in range(1, 700)), *("".join(rnd.choices(letters, k=rnd.choice([1, 2, 30, 400]))) for _ in range(60))]
    assert P.hash_embeddings(texts).tolist() == [P.hash_embedding(t) for t in texts]
    assert P.hash_embeddings(texts, 7).tolist() == [P.hash_embedding(t, 7) for t in texts]


def test_cuts_hold_so_many_rows_and_characters():
    texts = pa.array(["a" * n for n in (3, 3, 9, 1, 1, 1, 1)] + [None, "ab"])
    assert [len(p) for p in cut(texts, [texts], 3, 6)] == [2, 1, 3, 3]
    assert list(cut(texts.slice(0, 0), [texts.slice(0, 0)], 3, 6)) == []
