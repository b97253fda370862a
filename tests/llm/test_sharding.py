import numpy as np
import pytest

from evidara.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutes_and_comes_back(n):
    p = sharding.permute(np.arange(n), n, 9)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, 9, back=True).tolist() == list(range(n))
    for i in range(0, n, 7):
        assert sharding.row_at(*sharding.locate(i, n, 4, 9), n, 4, 9) == i


def test_shards_by_rank_of_key(spark):
    rows = [(i * 3 % 101, f"t{i}") for i in range(101)] + [(None, None), (5, "t"), (5, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({})
    out = sharding.assign_shards(df, 7, ties=["text"], seed=4).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.text) for r in out) == sorted((a is not None, a, b) for a, b in rows)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [(r.doc_id, r.text) for r in sorted(out, key=lambda r: r.row_number)] == want
    for r in out:
        assert (r.shard, r.slot) == sharding.locate(r.row_number, len(rows), 7, 4)
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_empty_and_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, shard string, slot string")
    assert sharding.assign_shards(df, 3).count() == 0
    df = spark.createDataFrame([(i, "x") for i in range(10)], "doc_id long, shard string")
    sharding.write_shards(df, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.doc_id for r in back) == list(range(10))
    assert {r.shard for r in back} == {0, 1, 2}
