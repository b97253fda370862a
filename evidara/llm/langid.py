"""Language identification by a convolutional network over bytes.

Filters of several widths slide over one-hot bytes of lower-cased UTF-8; each filter's
greatest response in a fixed-length window is kept, and a softmax gives the language of
the window. A document is cut into windows from end to end; its languages' probabilities
are the means over its windows, weighted by their bytes. Training is plain numpy with
Adam on the driver, over a sample bounded by docs_per_lang for each language, chosen by a
hash of the id. In the tasks, responses come from tables for pairs of bytes.

Defined cases: null texts and texts without a letter are `und` with score 0; documents
without lang are not learned from but predicted; without any labelled text all are `und`;
repeated rows stay; null ids and other columns, whatever their names, are not looked at; an
empty table gives an empty result; languages that tie come by name; very long texts are
read whole, in windows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_of, hold, slices

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 192
#: Windows that are computed at once.
BATCH = 64
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    langs: list[str]
    kernels: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def as_windows(data: bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in rows of size, the last padded with zeros, and how many bytes each row has."""
    n = max(1, -(-len(data) // size))
    rows = np.zeros(n * size, np.uint8)
    rows[: len(data)] = np.frombuffer(data, np.uint8)
    return rows.reshape(n, size), np.append(np.full(n - 1, size), len(data) - size * (n - 1))


def _responses(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest response of each filter in each window, and where it is."""
    best, where = [], []
    for k in net.kernels:
        n = x.shape[1] - len(k) + 1
        r = k[0][x[:, :n]]
        for j in range(1, len(k)):
            r += k[j][x[:, j : n + j]]
        at = r.argmax(axis=1)
        where.append(at)
        best.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :])
    return np.concatenate(best, axis=1) + net.bias, np.concatenate(where, axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 8, seed: int = 7, rate: float = 0.01) -> Network:
    """A network for windows (n, WINDOW) of bytes and indices into langs."""
    rng = np.random.default_rng(seed)
    size = FILTERS * len(WIDTHS)
    net = Network(langs, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(size, np.float32), rng.normal(0, 0.1, (size, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    for k in net.kernels:
        k[:, 0, :] = 0  # padding says nothing
    params = [*net.kernels, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = len(labels) / (len(langs) * np.maximum(1, np.bincount(labels, minlength=len(langs))))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x, y = windows[rows].copy(), labels[rows]
            for i in np.flatnonzero(rng.random(len(rows)) < 0.4):  # short texts are met too
                x[i, rng.integers(12, WINDOW) :] = 0
            pooled, where = _responses(net, x)
            hidden = np.maximum(pooled, 0)
            z = _softmax(hidden @ net.out + net.out_bias)
            z[np.arange(len(y)), y] -= 1
            z *= (weight[y] / len(y))[:, None].astype(np.float32)
            back = (z @ net.out.T) * (pooled > 0)
            grads = [np.zeros_like(k) for k in net.kernels]
            for g, (k, w) in enumerate(zip(grads, WIDTHS)):
                cols = slice(g * FILTERS, (g + 1) * FILTERS)
                for j in range(w):
                    bytes_at = np.take_along_axis(x, where[:, cols] + j, axis=1)
                    np.add.at(k[j], (bytes_at, np.broadcast_to(np.arange(FILTERS), bytes_at.shape)), back[:, cols])
                k[:, 0, :] = 0
            grads += [back.sum(axis=0), hidden.T @ z, z.sum(axis=0)]
            step += 1
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


class Predictor:
    """A network with its responses tabled for pairs of bytes."""

    def __init__(self, net: Network):
        self.net = net
        two, three, four = net.kernels
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.start = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1)
        self.third, self.last = three[2], pair(four[2], four[3])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(x), BATCH):
            rows = x[at : at + BATCH]
            wide = np.zeros((len(rows), WINDOW + 3), np.int32)
            wide[:, :WINDOW] = rows
            pairs = wide[:, :-1] * 256 + wide[:, 1:]
            r = self.start[pairs[:, :WINDOW]]
            r[:, :, FILTERS : 2 * FILTERS] += self.third[wide[:, 2 : WINDOW + 2]]
            r[:, :, 2 * FILTERS :] += self.last[pairs[:, 2 : WINDOW + 2]]
            best = np.concatenate([r[:, : WINDOW - w + 1, g * FILTERS : (g + 1) * FILTERS].max(axis=1) for g, w in enumerate(WIDTHS)], axis=1)
            out.append(_softmax(np.maximum(best + self.net.bias, 0) @ self.net.out + self.net.out_bias))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        rows, sizes, owners = [], [], []
        for i, t in enumerate(texts):
            if t and self.net.langs and _LETTER.search(t):
                x, n = as_windows(t.lower().encode("utf-8", "surrogatepass"))
                rows.append(x)
                sizes.append(n)
                owners.append(np.full(len(x), i))
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if rows:
            p = self.probabilities(np.concatenate(rows)) * np.concatenate(sizes)[:, None]
            owner = np.concatenate(owners)
            total = np.zeros((len(texts), len(self.net.langs)))
            np.add.at(total, owner, p)
            for i in np.unique(owner).tolist():
                k = int(total[i].argmax())
                langs[i], scores[i] = self.net.langs[k], float(min(1.0, total[i, k] / total[i].sum()))
        return langs, scores


def drawn(data: bytes) -> list[tuple[int, bytes]]:
    """All windows of a text in the order of a hash, each with its turn; a last one that is not full only where it is the only one."""
    x, sizes = as_windows(data)
    if len(x) > 1 and sizes[-1] < WINDOW:
        x = x[:-1]
    order = sorted(range(len(x)), key=lambda k: (zlib.crc32(x[k].tobytes(), k), k))
    return [(turn, x[k].tobytes()) for turn, k in enumerate(order)]


def fit(docs: DataFrame, docs_per_lang: int = 400, windows_per_lang: int = 1200) -> Network:
    """A network of docs (doc_id, text, lang), from ids outside fold 0 with a lang and a letter.

    docs_per_lang bounds the documents of each language, windows_per_lang the windows that are
    learned from: one of each document, by a hash over all its windows, then another of each,
    until there are as many. Any window of a document may be drawn, however long it is.
    """
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(F.col("lang").isNotNull() & (fold_of("doc_id") != 0))
    turn = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang").distinct().withColumn("part", F.pmod(F.hash("doc_id"), F.lit(64)))
    chosen = chosen.withColumn("eighth", F.col("part") % 8)
    for by in (["lang", "part"], ["lang", "eighth"], ["lang"]):  # a language may hold most rows, so parts of it are cut first
        chosen = chosen.withColumn("turn", turn(*by)).filter(F.col("turn") <= docs_per_lang)
    chosen = chosen.select("doc_id", "lang")
    chosen = spark.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, lang string")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[str, list[tuple[int, int, bytes]]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text and _LETTER.search(text):
                    own = drawn(text.lower().encode("utf-8", "surrogatepass"))[:windows_per_lang]
                    found.setdefault(lang, []).extend((turn, zlib.crc32(part), part) for turn, part in own)
            rows = [(lang, *w) for lang, ws in found.items() for w in sorted(ws)[:windows_per_lang]]
            columns = zip(*rows) if rows else ([], [], [], [])
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "turn", "mark", "part"])

    texts = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # one of each id, however often it is repeated
    cuts = texts.select("lang", "text").mapInArrow(cut, "lang string, turn long, mark long, part binary")
    order = Window.partitionBy("lang").orderBy("turn", "mark", "part")
    rows = cuts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= windows_per_lang).select("lang", "part").collect()
    rows = sorted((r["lang"], bytes(r["part"])) for r in rows)
    langs = sorted({r[0] for r in rows})
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([langs.index(r[0]) for r in rows], np.int64), langs)


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    names = ["doc_id", "held_out", "lang_pred", "score"]

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("langid", lambda: None)
        predictor = Predictor(sent.value)
        for batch in slices(batches, 64):
            langs, scores = predictor.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of("doc_id") == 0).alias("held_out"), "text").mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double")
