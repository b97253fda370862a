import base64
import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from evidara.llm import pii
from tests.llm.test_decontam import brute as brute_items
from tests.llm.test_neardup import brute as brute_groups

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


def word(rnd):
    return "".join(rnd.choice("an the or in é st ing".split()) for _ in range(rnd.randint(1, 4)))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(6)
    folder = str(tmp_path_factory.mktemp("sf"))
    items = [(i, " ".join(word(rnd) for _ in range(25))) for i in range(6)]
    docs, labels = [], []
    for i in range(300):
        w = [word(rnd) for _ in range(rnd.randint(8, 90))]
        if i % 5 == 0:
            w[rnd.randrange(len(w))] = "idiot"
        if i % 11 == 0:
            w += items[i % 6][1].split()
        if i % 7 == 0:
            w.append("me.x@mail.example.com")
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(300, 360):
        w = rnd.choice(docs[:300])[1].split()
        if i % 2:
            w[0] = word(rnd)
        docs.append((i, " ".join(w)))
    docs += [(400, None), (401, ""), (402, "short")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_equals_brute_force(spark, sf_dir):
    folder, docs, items = sf_dir
    left = [(i, t) for i, t in docs if "idiot" not in (t or "")]
    groups, _ = brute_groups(left, 5)
    keep = {i for i, _, _, kept in groups if kept}
    left = [d for d in left if d[0] in keep]
    leaked = {d for d, *_ in brute_items(left, items)}
    left = [d for d in left if d[0] not in leaked]
    text_of = {i: (t or "").replace("me.x@mail.example.com", "[EMAIL]") for i, t in left}
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in text_of.items():
        ids = e.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, folder).collect()}
    assert len(got) < 0.8 * len(docs) and leaked
    assert got == want


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir[0])
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), sf_dir[0]).count() == 0


def test_redaction_finds_planted_spans():
    model = pii.learn({})
    assert pii.redacted("mail a.b@c.de", model) == "mail [EMAIL]"
