"""The registered queries over whole tables, against plain Python on the smallest one."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from evidara.llm.queries import QUERIES

from . import test_bpe, test_decontam, test_neardup, test_pii, test_quality, test_token_store

FOLDER = "/root/testdata/sf0.001"


def read(name, folder=FOLDER):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"]) for r in read("documents")]


@pytest.fixture(scope="module")
def got(spark):
    made = {}

    def rows(name, folder=FOLDER):
        if (name, folder) not in made:
            made[name, folder] = QUERIES[name](spark, folder).collect()
        return made[name, folder]

    return rows


def test_op1(got, docs):
    rows = {r.doc_id: r for r in got("op1_feistel_shards")}
    assert set(rows) == {i for i, _ in docs}
    for i, t in docs:
        assert (rows[i].size, rows[i].text_crc32, rows[i].law, rows[i].grown_shard) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None)
    slots = defaultdict(list)
    for r in rows.values():
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op2(got, docs):
    assert sorted((tuple(r) for r in got("op2_token_files")), key=lambda r: r[1]) == test_token_store.brute(docs)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op3(got):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in got("op3_toxicity", folder)}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    judged = [(rows[r["doc_id"]].score, r["toxic"]) for r in read("labels", folder) if held_out(r["doc_id"])]
    bad, good = [s for s, y in judged if y], [s for s, y in judged if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    assert auc > 0.95
    assert sum((s >= 0.5) == bool(y) for s, y in judged) >= 0.98 * len(judged)


def test_op4(got, docs):
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = [(i, name, m.start(), m.end()) for i, t in docs for line, name in lines.items() for m in re.finditer(rf"(?m)^{re.escape(line)}$", t)]
    assert sorted((r.doc_id, r.license, r.start, r.end) for r in got("op4_licenses")) == sorted(want)


def test_op5(got, docs):
    rows = {r.doc_id: r for r in got("op5_line_quality")}
    for i, t in docs:
        b = test_quality.brute(t)
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines, rows[i].n_repeat_words) == b
        assert rows[i].base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (rows[i].kept and rows[i].base_failed)
    quality = {r["doc_id"]: r["quality"] for r in read("labels")}
    judged = [(rows[i].kept, q) for i, q in quality.items() if not rows[i].base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.95 * len(judged)


def test_op6(got, docs):
    import numpy as np

    rows = {r.doc_id: r for r in got("op6_byte_bpe")}
    for (i, t), ids in zip(docs, test_bpe.expected([t for _, t in docs])):
        assert tuple(rows[i])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op7(got, docs):
    rows = {r.doc_id: r for r in got("op7_personal_data")}
    for i, t in docs:
        base = [f"{k}:{a}:{b}" for k, a, b in test_pii.brute(t)]
        n = Counter(x.split(":")[0] for x in base)
        assert [rows[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [n[k] for k in ("email", "ip", "card", "phone")]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(rows[i].spans.split(",")) or not base


def test_op8(got, docs):
    items = [(r["item_id"], r["text"]) for r in read("benchmark")]
    want = test_decontam.brute(docs, items)
    assert want and sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got("op8_decontamination")), key=str) == want


def test_op9(got):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in got("op9_language", folder)}
    truth = {r["doc_id"]: r["lang"] for r in read("documents", folder)}
    held = [i for i in truth if held_out(i)]
    assert all(rows[i].held_out == held_out(i) for i in truth)
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.96 * len(held)


def test_op10(got, docs):
    want, _ = test_neardup.brute(docs, 4)
    assert sorted(tuple(r) for r in got("op10_near_duplicates")) == want
