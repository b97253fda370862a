"""Toxicity by a weighted lexicon, matched by one Aho-Corasick pass over folded text.

Folding lowers case, maps look-alike letters of other scripts and digits that stand for
letters, and @ and $ inside words; it keeps the length, so matches are places in the text.
Lexicon entries are whole words or word beginnings; matches inside an exception phrase do
not count. The score is a logistic function of the heaviest match, of the sum of weights,
and of that sum per 100 words.

The entries are a short fixed list and those that labelled documents support; weights are
log-odds of document counts over the labelled sample. The sample is bounded by
max_fit_docs, half of it toxic at most, chosen by a hash of the id, and of an id with
several texts the least counts; every document is scored on its whole text.

Defined cases: null and empty texts, and texts without a match, have the score of no
match; labels without a value and documents without a label do not count; a document
with two labels counts as toxic if one says so; repeated rows stay; without labels the
fixed list has its prior weights; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, hold, materialize, slices

# The starting lexicon (word beginnings), exception phrases and look-alikes.
BASE_TERMS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown",
    "imbecile", "bastard", "asshole", "bitch", "dumbass", "shit", "fuck", "whore", "slut", "retard",
)
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "clownfish", "class clown", "clown car", "sore loser",
    "pathetic fallacy", "idiot proof", "idiot-proof", "stupid simple", "pond scum", "retarded growth", "flame retardant",
)
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ρ": "p", "τ": "t", "υ": "u",
    "ν": "v", "κ": "k", "ı": "i", "ⅰ": "i", "ℓ": "l", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
}

_FOLD = str.maketrans(LOOKALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_INNER = re.compile(r"(?<=[^\W\d_])[@$]+(?=[^\W\d_])")
_ALPHA = re.compile(r"[^\W\d_]+")
PREFIX = range(4, 9)
PRIOR = 2.0


def fold(text: str | None) -> str:
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    if "@" in low or "$" in low:
        low = _INNER.sub(lambda m: m[0].replace("@", "a").replace("$", "s"), low)
    return low.translate(_FOLD)


@dataclass
class Model:
    """Entries ((term, is a beginning) and weight), exception phrases, and logistic coefficients."""

    weights: dict[tuple[str, bool], float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = (-3.0, 1.0, 0.5, 0.5)


def outside(found: list[tuple[int, int, float]], shields: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """Places that lie within none of the shields: of those that begin before a place, the one that ends last tells."""
    if not shields:
        return found
    shields.sort()
    starts, ends = [a for a, _ in shields], list(accumulate((b for _, b in shields), max))
    return [f for f in found if not (k := bisect_right(starts, f[0])) or ends[k - 1] < f[1]]


class Matcher:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list] = defaultdict(list)
        for (term, start), w in model.weights.items():
            by[term].append((start, w))
        for phrase in model.exceptions:
            by[phrase].append((None, 0.0))
        for term, what in by.items():
            self.automaton.add_word(term, (len(term), what))
        if by:
            self.automaton.make_automaton()
        self.any = bool(by)

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each counted match."""
        if not self.any:
            return []
        found, shields, n = [], [], len(folded)
        for last, (size, what) in self.automaton.iter(folded):
            a, b = last - size + 1, last + 1
            if a and folded[a - 1].isalpha():
                continue
            for start, w in what:
                if start is None:
                    shields.append((a, b))
                elif start or b == n or not folded[b].isalpha():
                    found.append((a, b, w))
        return outside(found, shields)

    def features(self, text: str | None) -> tuple[float, float, float]:
        folded = fold(text)
        found = self.matches(folded)
        if not found:
            return 0.0, 0.0, 0.0
        total = sum(w for _, _, w in found)
        words = max(1, len(folded.split()))
        return max(w for _, _, w in found), math.log1p(max(0.0, total)), math.log1p(max(0.0, 100 * total / words))

    def score(self, text: str | None) -> float:
        z = self.model.coefficients[0] + sum(c * x for c, x in zip(self.model.coefficients[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents of each word and word beginning, summed as far as a task's memory allows."""
    schema = pa.schema([("term", pa.string()), ("start", pa.bool_()), ("bad", pa.int64()), ("good", pa.int64())])
    hold("toxicity", lambda: None)
    counts = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        rows = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *(pa.array([counts[i][k] for k in keys], pa.int64()) for i in (1, 0))], schema=schema)
        counts[0].clear()
        counts[1].clear()
        return rows

    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(_ALPHA.findall(fold(text)))
            seen = {(w, False) for w in words if 3 <= len(w) <= 24}
            seen |= {(w[:k], True) for w in words for k in PREFIX if len(w) >= k}
            counts[toxic].update(seen)
        if len(counts[0]) + len(counts[1]) > 200_000:
            yield out()
    yield out()


def ranked_terms(counted: DataFrame, bad: int, good: int) -> DataFrame:
    """(term, start, bad, ratio) of all terms that toxic documents have far more often, those with the
    most evidence (log-likelihood against one rate for all) first; of equal evidence whole words, then the longest."""
    share, n = bad / (bad + good), F.col("bad") + F.col("good")
    part = lambda c, s: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * s))).otherwise(0.0)
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1)))
    d = counted.withColumn("ratio", ratio).withColumn("evidence", F.round(part("bad", share) + part("good", 1 - share), 6))
    d = d.filter((F.col("ratio") >= 1.5) & (F.col("bad") / bad > F.col("good") / good) & (F.col("evidence") > 16))
    return d.orderBy(F.desc("evidence"), "start", F.desc(F.length("term")), F.desc("term")).select("term", "start", "bad", "ratio")


def choose_terms(ranked: Iterable[tuple[str, bool, int, float]], base: dict[str, tuple[int, int]], bad: int, good: int, most: int) -> dict[tuple[str, bool], float]:
    """Weights of the first entries of ranked_terms' rows of which none says the same as one before it, and of the fixed list.

    most bounds the lexicon; rows are taken until it is full, so there may be any number of
    them. base has toxic and clean counts of the word beginnings of the fixed list.
    """
    chosen: dict[tuple[str, bool], float] = {}
    support: dict[str, int] = {}
    for term, start, t, ratio in ranked:
        if len(chosen) >= most:
            break
        if any(term.startswith(p) and (p, True) in chosen for p in (term[:k] for k in range(3, len(term) + 1))):
            continue
        if any(s.startswith(term) and t < 1.5 * n for s, n in support.items()):
            continue
        chosen[term, start] = ratio
        support[term] = t
    for term in BASE_TERMS:
        t, c = base.get(term[:8], (0, 0)) if len(term) >= 4 else (0, 0)
        if not any(term.startswith(p) for (p, s) in chosen if s):
            chosen.pop((term, False), None)
            w = math.log((t + 1) / (bad + 1) / ((c + 0.02) / (good + 1))) if t + c >= 3 else PRIOR
            if w > 0:
                chosen[term, True] = w
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.eye(len(w)) * ridge * len(x) / 10
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_fit_docs: int = 8000, max_terms: int = 400) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic), of ids outside fold 0 only.

    max_fit_docs bounds the labelled documents that are read for it, max_terms the learned entries of
    the lexicon, of most evidence first.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(fold_of("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    sample = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(max_fit_docs // 2) for k in (0, 1)]
    sample = spark.createDataFrame([tuple(r) for part in sample for r in part.collect()], "doc_id long, toxic int")
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # one text of each id, however often the id is repeated
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model({(t, True): PRIOR for t in BASE_TERMS})
    counted = texts.select("text", "toxic").mapInArrow(_term_counts, "term string, start boolean, bad long, good long").groupBy("term", "start").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = materialize(counted, "terms")
    base = {r["term"]: (r["bad"], r["good"]) for r in counted.filter(F.col("start") & F.col("term").isin([t[:8] for t in BASE_TERMS])).collect()}
    model = Model(choose_terms(map(tuple, ranked_terms(counted, bad, good).toLocalIterator()), base, bad, good, max_terms))
    sent = spark.sparkContext.broadcast(model)

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        hold("toxicity", lambda: None)
        for batch in slices(batches):
            rows = [matcher.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([r[i] for r in rows], pa.float64()) for i in range(3))], names=["toxic", "a", "b", "c"])

    rows = texts.select("text", "toxic").mapInArrow(featured, "toxic int, a double, b double, c double").collect()
    table = np.array(sorted(tuple(r) for r in rows), float)
    w = _logistic(table[:, 1:], table[:, 0])
    w[0] += math.log(shares.get(1, 1) / shares.get(0, 1)) - math.log(bad / good)
    model.coefficients = tuple(float(x) for x in w)
    return model


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text); with spans also
    matches, an array of (start, end, weight) in code points of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())])
    schema = pa.schema(fields + [("matches", pa.list_(span))] * spans)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            scores = [matcher.score(t) for t in texts]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            if spans:
                columns.append(pa.array([[{"start": a, "end": b, "weight": w} for a, b, w in matcher.matches(fold(t))] for t in texts], pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ids = F.col("doc_id").cast("long").alias("doc_id")
    kinds = "doc_id long, held_out boolean, score double, predicted int" + ", matches array<struct<start:int,end:int,weight:double>>" * spans
    return docs.select(ids, (fold_of("doc_id") == 0).alias("held_out"), "text").mapInArrow(apply, kinds)


def drop_toxic(docs: DataFrame, labels: DataFrame, max_fit_docs: int = 8000) -> DataFrame:
    """docs, all columns, without those predicted toxic. Rows are judged by their text in one pass."""
    model = fit(docs, labels, max_fit_docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", lambda: None)
        matcher = Matcher(sent.value)
        for batch in slices(batches):
            keep = [matcher.score(t) < 0.5 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)
