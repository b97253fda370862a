import base64
import hashlib
import random

import numpy as np
import pytest

from evidara.llm import bpe, chunks

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def expected(texts):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [e.encode_ordinary(t or "") for t in texts]


def texts(n=400):
    rnd = random.Random(7)
    kinds = ["abcdef", "aeiourst  \n", "éñß\x1c\x85　\t'stre ", " 0123!?.,; x", "日本語かな .", "THEan ing.\n", "\0a b\n", "!" * 4]
    out = [None, "", " ", "\n", "\n\n", " a", "a ", "a  b", "don't we'll", "<|endoftext|>", "a" * 3000, "é" * 500, "x." * 2000, "word.\nnext, word", "it's.'s"]
    for _ in range(n):
        k = rnd.choice(kinds)
        out.append("".join(rnd.choice(k) for _ in range(rnd.randint(0, 50))))
    return out


def test_equals_tiktoken_and_round_trips(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CACHE", 50)
    ts = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)] + [(None, "a"), (3, "again")], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.encode_documents(df, PATH, P.PATTERN).filter("doc_id is null or doc_id <> 3").collect()}
    for i, ids in enumerate(expected(ts)):
        if i != 3:
            assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids, ts[i]
            assert rows[i].n_tokens == len(ids)
    enc = bpe.encode_documents(df, PATH, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode_documents(enc, PATH, P.PATTERN).filter("doc_id is null or doc_id <> 3").collect()} == {i: t or "" for i, t in enumerate(ts) if i != 3} | {None: "a"}
    digests = {r.doc_id: r for r in bpe.encode_documents(df, PATH, P.PATTERN, digests=True).filter("doc_id is null or doc_id <> 3").collect()}
    for i, t in enumerate(ts):
        if i != 3:
            assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
            assert digests[i].ids_sha256 == hashlib.sha256(bytes(rows[i].ids)).hexdigest()


def test_backtracking_equals_merging_on_random_vocabularies():
    rnd = random.Random(3)
    for _ in range(25):
        letters = "abc"
        vocab, words = list(letters), ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 12))) for _ in range(40)]
        split = [list(w) for w in words]
        for _ in range(rnd.randint(3, 25)):
            pairs = [(a, b) for w in split for a, b in zip(w, w[1:])]
            if not pairs:
                break
            a, b = rnd.choice(pairs)
            if a + b in vocab:
                continue
            vocab.append(a + b)
            rank = {t: i for i, t in enumerate(vocab)}
            split = [bpe.merge_by_rank(w, rank)[0] for w in words]
        raw = b"\n".join(base64.b64encode(t.encode()) + b" %d" % i for i, t in enumerate(vocab))
        own = bpe.ByteBPE(raw, r"\S+")
        rank = {t: i for i, t in enumerate(vocab)}
        for _ in range(60):
            w = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30)))
            want = [rank[w]] if w in rank else [rank[x] for x in bpe.merge_by_rank(w, rank)[0]]
            assert own.encode_piece(w) == want, (w, vocab)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(empty, PATH, P.PATTERN).count() == 0
    df = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, ids string, n_tokens int")
    assert bpe.encode_documents(df, PATH, P.PATTERN).columns == ["doc_id", "n_tokens", "ids"]


def test_every_letter_class_is_that_of_the_libraries():
    """Python's notion of letters, digits and white space, on which cutting rests, against both libraries' in six positions of every character."""
    tokenizers = pytest.importorskip("tokenizers")
    from evidara.llm import token_store

    with open(PATH, "rb") as f:
        own = bpe.ByteBPE(f.read(), P.PATTERN)
    other = P.path("byte_bpe_50k.json")
    theirs = tokenizers.Tokenizer.from_file(other)
    with open(other, encoding="utf-8") as f:
        encoder = token_store._Encoder(f.read())
    chars = [chr(c) for c in [*range(1, 0xD800, 3), *range(0xE000, 0x10000, 3), *range(0x10000, 0x20000, 17)]]
    ts = [f"a{c}b {c} {c}. 1{c} x{c}\n{c}y {c}1" for c in chars]
    assert own.by_chunk
    for t, ids in zip(ts, expected(ts)):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, ascii(t)
    for t, e, ids in zip(ts, theirs.encode_batch(ts, add_special_tokens=False), encoder.encode_all(ts)):
        assert np.frombuffer(ids, encoder.kind).tolist() == e.ids, ascii(t)


def test_other_patterns_are_not_cut():
    with open(PATH, "rb") as f:
        raw = f.read()
    own, pattern = bpe.ByteBPE(raw, r"\w+ \w+|."), r"\w+ \w+|."
    assert not own.by_chunk and chunks.PATTERN == P.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for t in ("the new car of the man", "two  spaces here", "é and the"):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == e.encode_ordinary(t)


def test_long_chunks_are_not_kept():
    with open(PATH, "rb") as f:
        own = bpe.ByteBPE(f.read(), P.PATTERN)
    own.encode("日本" * 500 + " short " + "x" * 400)
    assert max(map(len, own.chunks)) <= chunks.LONGEST and " ".join(own.chunks).count("short") == 1
