import zlib

import numpy as np
import pytest

from evidara.llm import token_store as ts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    mph = ts.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))


def brute(rows):
    t = tokenizers.Tokenizer.from_file(PATH)
    at, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark):
    rows = [(i * 7 % 230, f"Text {i}, and\nmore é text." * (i % 4)) for i in range(230)]
    rows += [(5, "again"), (5, "again"), (None, "no key"), (None, None), (300, None), (301, ""), (302, "a <|endoftext|> b"), (303, "tab\tand  two"), (304, "x" * 5000), (-9, "minus")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder, manifest = ts.write_token_files(df, PATH, docs_per_shard=50)
    got = sorted((tuple(r) for r in ts.read_token_files(folder, manifest, df).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    assert ts.read_token_files(folder, manifest, spark.createDataFrame([(777,)], "doc_id long")).count() == 0
    shard = next(r.shard for r in manifest.collect() if r.low is not None and r.low <= 302 <= r.high)
    t = tokenizers.Tokenizer.from_file(PATH)
    opened = ts.Shard(folder, shard)
    assert opened.get(302)[0].tolist() == [*t.encode("a <|endoftext|> b", add_special_tokens=False).ids, 2]
    assert opened.get(10**12) == []


def test_a_frequent_key_lies_in_several_shards(spark):
    rows = [(i, f"text {i}") for i in range(60)] + [(30, f"{k % 40} again") for k in range(200)] + [(None, f"n{k}") for k in range(150)] + [(31, "the same")] * 150
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder, manifest = ts.write_token_files(df, PATH, docs_per_shard=60)
    shards = manifest.collect()
    assert sum(r.low is not None and r.low <= 30 <= r.high for r in shards) > 1 and sum(r.low is not None and r.low <= 31 <= r.high for r in shards) > 1
    assert sum(r.without_key > 0 for r in shards) > 1 and max(r.documents for r in shards) < 200
    got = sorted((tuple(r) for r in ts.read_token_files(folder, manifest, df).collect()), key=lambda r: r[1])
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in brute(rows))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()[:-1]]
    assert [r[0] for r in got] == [None] * 150 + sorted(i for i, _ in rows if i is not None)


def test_failed_attempts_leave_no_files(spark, tmp_path):
    (tmp_path / "shard-000000.ids.77").write_bytes(b"left")
    folder, manifest = ts.write_token_files(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH, f"file://{tmp_path}")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["manifest", "shard-000000.ids", "shard-000000.idx"] and manifest.count() == 1


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder, manifest = ts.write_token_files(df, PATH)
    assert manifest.count() == 0
    assert ts.read_token_files(folder, manifest, df).count() == 0
    df = spark.createDataFrame([(1, "a", 3, "s")], "doc_id long, text string, shard int, key string")
    folder, manifest = ts.write_token_files(df, PATH)
    assert ts.read_token_files(folder, manifest, df).count() == 1


def test_a_chunk_is_looked_up_once_for_many_texts():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    with open(PATH, encoding="utf-8") as f:
        encoder = ts._Encoder(f.read())
    encoder.known = Counted()
    texts = ["one two", None, "", "a  b", "é, 　", "x\ny <|endoftext|>", "\n"] + ["one two three"] * 1000 + ["end.", "tab\t"]
    batch = ts.pa.RecordBatch.from_pydict({"text": texts})
    got = [encoder.encode_joined(b.column("text").to_pylist(), 2) for b in ts._small([batch])]
    t = tokenizers.Tokenizer.from_file(PATH)
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    assert [n for _, sizes in got for n in sizes.tolist()] == list(map(len, want))
    assert np.concatenate([ids for ids, _ in got]).tolist() == sum(want, [])
    assert Counted.asked < 20  # before: once for every 64 texts
    assert encoder.encode_joined([])[0].tolist() == [] and encoder.encode_joined([None], 2)[0].tolist() == [2]
    long = ts.pa.RecordBatch.from_pydict({"text": ["a" * ts.BYTES, "b", None, "c" * (ts.BYTES + 1), "d"]})
    assert [b.num_rows for b in ts._small([long])] == [1, 2, 1, 1]
