import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from evidara.llm import langid

SYLLABLES = {"aa": "ka lo mi tu re no".split(), "bb": "ßch ung ein ät der".split(), "cc": "ción ña el os ar".split()}


def corpus(n=360, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(SYLLABLES))
        words = ["".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(6, 200))]
        rows.append((i, " ".join(words), lang if rnd.random() < 0.9 else None, lang))
    return rows


def test_learns_and_holds_out(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, lang, 1.0) for i, t, lang, _ in rows] + [(900, None, "aa", 0.0), (901, "12 34 _", None, 0.0), (902, "", "bb", 0.0), (None, "ka lo mi", "aa", 0.0)], "doc_id long, text string, lang string, score double")
    net = langid.fit(df)
    got = {r.doc_id: r for r in langid.predict(df, net).collect()}
    held = [(i, truth) for i, _, _, truth in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held)
    assert sum(got[i].lang_pred == truth for i, truth in held) >= 0.97 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[None].lang_pred in SYLLABLES and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    swapped = df.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'zz', lang) as lang")
    again = langid.fit(swapped)
    assert again.langs == net.langs and all((a == b).all() for a, b in zip(again.kernels, net.kernels))


def test_tables_equal_the_network():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (70, langid.WINDOW), dtype=np.uint8)
    net = langid.train(x, rng.integers(0, 3, 70), ["a", "b", "c"], epochs=1)
    pooled, _ = langid._responses(net, x)
    want = langid._softmax(np.maximum(pooled, 0) @ net.out + net.out_bias)
    assert np.allclose(langid.Predictor(net).probabilities(x), want, atol=1e-4)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    net = langid.fit(df)
    assert [tuple(r)[2:] for r in langid.predict(df, net).collect()] == [("und", 0.0)]
    assert langid.predict(df.limit(0), net).count() == 0


def test_forward_pass_equals_loops():
    """Each filter at each place of each window, by plain loops, against the tables for pairs of bytes."""
    rng = np.random.default_rng(3)
    size = langid.FILTERS * len(langid.WIDTHS)
    kernels = [rng.normal(0, 1, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS]
    for k in kernels:
        k[:, 0, :] = 0
    net = langid.Network(["a", "b", "c"], kernels, rng.normal(0, 1, size).astype(np.float32), rng.normal(0, 1, (size, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))
    data = [bytes(rng.integers(1, 256, n, dtype=np.uint8)) for n in (1, 2, 3, 191, 192, 193, 400)]
    for text in data:
        x, sizes = langid.as_windows(text)
        assert sizes.sum() == len(text) and b"".join(r.tobytes() for r in x)[: len(text)] == text
        got = langid.Predictor(net).probabilities(x)
        for row, p in zip(x, got):
            best = []
            for k in kernels:
                sums = [sum(k[j, row[i + j]].astype(float) for j in range(len(k))) for i in range(langid.WINDOW - len(k) + 1)]
                best.append(np.max(sums, axis=0))
            z = np.maximum(np.concatenate(best) + net.bias, 0) @ net.out.astype(float) + net.out_bias
            want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert np.allclose(p, want, atol=1e-4)


def test_any_window_of_a_long_text_may_be_drawn(spark):
    long = "".join(f"{k:06d}" + "k" * (langid.WINDOW - 6) for k in range(50)).encode()
    turns = langid.drawn(long)
    assert [t for t, _ in turns] == list(range(50)) and len({w for _, w in turns}) == 50
    assert [w for _, w in turns] != sorted(w for _, w in turns)
    assert len(langid.drawn(long + b"rest")) == 50 and langid.drawn(b"rest")[0][1].rstrip(b"\0") == b"rest"
    rows = [(i, "ka lo mi " * (2000 if i == 0 else 3), "aa") for i in range(30)] + [(100 + i, "ßch ung ein " * 4, "bb") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit(7)).withColumn("turn", F.lit("x"))
    net = langid.fit(df, windows_per_lang=40)
    assert net.langs == ["aa", "bb"]
    same = langid.fit(df.repartition(5), windows_per_lang=40)
    assert all((a == b).all() for a, b in zip(same.kernels, net.kernels))
    got = langid.predict(df, net)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and {(r.doc_id < 100, r.lang_pred) for r in got.collect()} == {(True, "aa"), (False, "bb")}
