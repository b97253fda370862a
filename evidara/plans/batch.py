"""Many requests searched in all documents in one go, by each mode of an evaluation grid; the grid can be resumed.

Documents meet cases by equal words: those that have the rarest word of a case are asked for its
whole phrase, and their hits, whole and by chunks, are written once for all modes. Ranks are cut
before they are shuffled. Of the cases a mode takes a block at a time.

    exact               documents with the phrase of a case, by BM25
    parent_child        documents by the best of their chunks with the phrase
    fts                 the phrase, then the case's two rarest words, in this order, each document once
    vector              nearest documents by the vectors that are given
    hybrid-weighted     all routes by weighted reciprocal ranks
    hybrid-rrf          all routes by plain reciprocal ranks
    vector-unavailable  as hybrid-weighted, without vectors
    feature-rerank      the first of hybrid-weighted, by phrase, words and routes

Defined cases: a case without words, null or empty, finds nothing but by vector; so does one with
a word that no document has, but for its other words in fts. Documents that tie come by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import lookup as K
from ..operators.lexical import B, K1, LEAST_IDF
from ..operators.ranking import top_vectors_many
from ..operators.store import Change, Store
from ..sources.scratch import settled
from .search import CHUNK, STRIDE, WEIGHTS

MODES = ("exact", "fts", "parent_child", "vector", "hybrid-weighted", "hybrid-rrf", "vector-unavailable", "feature-rerank")
# Boosts of a phrase (anywhere, in the content), of each word, and of the routes that found a row.
PHRASE_BOOST, WORD_BOOST, ROUTE_BOOSTS = 6.75, 1.25, {"exact": 1.0, "evidence": 0.8, "vector": 0.4}


def spaced(c: Column) -> Column:
    """Words, each between spaces of its own, so that hits of phrases do not share any."""
    return F.concat(F.lit(" "), F.array_join(c, "  "), F.lit(" "))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of a phrase in the words of a document, and in those of its chunks that have any."""
    chunk = pa.list_(pa.struct([("k", pa.int32()), ("tf", pa.int64()), ("size", pa.int32())]))
    for batch in batches:
        tf, chunks = [], []
        for phrase, text in zip(batch.column("phrase"), batch.column("words")):
            p, t = phrase.as_py(), text.as_py()
            tf.append(t.count(p))
            pieces = (t[at : at + CHUNK] for at in range(0, max(len(t) - (CHUNK - STRIDE), 1), STRIDE))
            chunks.append([{"k": k, "tf": n, "size": len(piece)} for k, piece in enumerate(pieces) if (n := piece.count(p))])
        kept = [batch.column(c) for c in ("case_id", "key", "size")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(tf, pa.int64()), pa.array(chunks, chunk)], ["case_id", "key", "size", "tf", "chunks"])


def corpus_sizes(docs: DataFrame) -> DataFrame:
    """One row of documents (key, text, or K.worded) and chunks, and their mean lengths in words and characters."""
    d = docs.select(K.words_of(docs).alias("w")).select("w", F.length(spaced(F.col("w"))).alias("c"))
    n = F.greatest(F.ceil((F.col("c") - (CHUNK - STRIDE)) / F.lit(STRIDE)), F.lit(1)).cast("long")
    length = F.col("c") + (n - 1) * (CHUNK - STRIDE)
    return settled(d.agg(F.count("*").alias("rows"), F.avg(F.size("w")).alias("mean"), F.sum(n).alias("chunks"), (F.sum(length) / F.sum(n)).alias("chunk_mean")), "sizes")


def _bm25(rows: str, df: str, tf: str, size: str, mean: str) -> Column:
    n, d, t = F.col(rows), F.col(df), F.col(tf)
    idf = F.greatest(F.log((n - d + 0.5) / (d + 0.5)), F.lit(LEAST_IDF))
    return F.round(idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col(size) / F.col(mean))), 6)


def _first(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """rank, from 1, of the first k rows of each group: the window's bound is taken in each task before rows are sent."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


class BatchSearch:
    """docs (key, text, or K.worded) searched for cases (case_id, query); vectors (key, vector) and query_vectors (case_id, q) where there are any.

    table is a K.term_table of docs that has the words of all queries, if there is one already.
    """

    def __init__(self, docs: DataFrame, cases: DataFrame, sizes: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, limit: int = 10, depth: int = 30, window: int = 50, table: DataFrame | None = None):
        self.docs, self.sizes, self.vectors, self.query_vectors = docs, sizes, vectors, query_vectors
        self.limit, self.depth, self.window = limit, depth, window
        self.cases = cases.select("case_id", F.col("query").alias("text"))
        self.table = K.term_table(docs, self.cases) if table is None else table

    def part(self, cases: DataFrame) -> BatchSearch:
        """The same for some of the cases, with the words and hits of all of them, which are found once."""
        own = cases.select("case_id")
        asked = None if self.query_vectors is None else self.query_vectors.join(own, "case_id", "left_semi")
        out = BatchSearch(self.docs, cases, self.sizes, self.vectors, asked, self.limit, self.depth, self.window, self.table)
        out.hits = self.hits.join(own, "case_id", "left_semi")
        return out

    @cached_property
    def hits(self) -> DataFrame:
        """(case_id, key, tf, size, chunks) of documents with the phrase of a case; chunks are those with hits (k, tf, size)."""
        asked = self.cases.select("case_id", K.words(F.col("text")).alias("w")).select("case_id", spaced(F.col("w")).alias("phrase"), F.size(F.array_distinct("w")).alias("n")).filter("n > 0")
        known = K.frequencies(self.cases, self.table).groupBy("case_id").agg(F.count("*").alias("found"), F.min(F.struct("df", "word")).alias("r"))
        anchors = asked.join(known, "case_id").filter("found = n").select("case_id", "phrase", F.col("r.word").alias("word"))
        met = self.table.select("key", "word", "size").join(anchors, "word").drop("word").join(self.docs.select("key", spaced(K.words_of(self.docs)).alias("words")), "key")
        found = met.filter(F.col("words").contains(F.col("phrase"))).select("case_id", "key", "size", "phrase", "words")
        kinds = ", ".join(f"{n} {t}" for n, t in found.dtypes[:3])
        return settled(found.mapInArrow(_counted, f"{kinds}, tf long, chunks array<struct<k: int, tf: long, size: int>>"), "phrase-hits")

    def _with(self, df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("case_id").agg(F.count("*").alias("df")), "case_id").join(F.broadcast(self.sizes))

    @cached_property
    def exact(self) -> DataFrame:
        scored = self._with(self.hits.drop("chunks")).select("case_id", "key", _bm25("rows", "df", "tf", "size", "mean").alias("score"))
        return settled(_first(scored, ["case_id"], [F.desc("score"), F.asc("key")], self.depth).select("case_id", "key", "rank"), "exact")

    @cached_property
    def evidence(self) -> DataFrame:
        scored = self._with(self.hits.select("case_id", "key", F.inline("chunks"))).withColumn("score", _bm25("chunks", "df", "tf", "size", "chunk_mean"))
        best = _first(scored, ["case_id"], [F.desc("score"), F.asc("key"), F.asc("k")], self.depth).groupBy("case_id", "key").agg(F.min("rank").alias("o"))
        return settled(_first(best, ["case_id"], [F.asc("o")], self.depth).select("case_id", "key", "rank"), "evidence")

    @cached_property
    def fts(self) -> DataFrame:
        words = K.rarest(self.cases, self.table, 2)
        words = words.withColumn("turn", F.row_number().over(Window.partitionBy("case_id").orderBy("df", "word")))
        scored = self.table.join(words, "word").join(F.broadcast(self.sizes)).select("case_id", "turn", "key", _bm25("rows", "df", "tf", "size", "mean").alias("score"))
        each = _first(scored, ["case_id", "turn"], [F.desc("score"), F.asc("key")], self.depth)
        both = self.exact.withColumn("turn", F.lit(0)).unionByName(each.select("case_id", "key", "rank", "turn"))
        first = both.groupBy("case_id", "key").agg(F.min(F.struct("turn", "rank")).alias("o"))
        return settled(_first(first, ["case_id"], [F.asc("o")], self.depth).select("case_id", "key", "rank"), "fts")

    @cached_property
    def nearest(self) -> DataFrame:
        if self.vectors is None or self.query_vectors is None:
            raise ValueError("no vectors were given")
        return settled(top_vectors_many(self.vectors, self.query_vectors, self.depth, "key", "case_id").select("case_id", "key", F.col("rank").cast("long").alias("rank")), "nearest")

    def _routes(self, vectors: bool) -> dict[str, DataFrame]:
        return {"exact": self.exact, "evidence": self.evidence, **({"vector": self.nearest} if vectors else {}), "fts": self.fts}

    def _fused(self, k: int, weighted: bool = True, vectors: bool = True) -> DataFrame:
        return K.fused([(WEIGHTS[n] if weighted else 1.0, r) for n, r in self._routes(vectors).items()], k)

    @cached_property
    def reranked(self) -> DataFrame:
        held = self._fused(self.window).drop("rank")
        own = self.cases.select("case_id", F.explode(F.array_distinct(K.words(F.col("text")))).alias("word"))
        words = held.select("case_id", "key").join(own, "case_id").join(self.table.select("key", "word"), ["key", "word"]).groupBy("case_id", "key").agg(F.count("*").alias("words"))
        j = held.join(words, ["case_id", "key"], "left").join(self.hits.select("case_id", "key", F.lit(PHRASE_BOOST).alias("phrase")), ["case_id", "key"], "left")
        score = F.col("score") + F.coalesce("phrase", F.lit(0.0)) + WORD_BOOST * F.coalesce("words", F.lit(0))
        for name, boost in ROUTE_BOOSTS.items():
            j = j.join(self._routes(True)[name].select("case_id", "key", F.lit(boost).alias(f"by_{name}")), ["case_id", "key"], "left")
            score = score + F.coalesce(f"by_{name}", F.lit(0.0))
        return _first(j.select("case_id", "key", F.round(score, 6).alias("score")), ["case_id"], [F.desc("score"), F.asc("key")], self.limit)

    def results(self, mode: str) -> DataFrame:
        """(case_id, key, rank) of the first results of every case."""
        ways: dict[str, Callable[[], DataFrame]] = {
            "exact": lambda: self.exact,
            "fts": lambda: self.fts,
            "parent_child": lambda: self.evidence,
            "vector": lambda: self.nearest,
            "hybrid-weighted": lambda: self._fused(self.limit),
            "hybrid-rrf": lambda: self._fused(self.limit, weighted=False),
            "vector-unavailable": lambda: self._fused(self.limit, vectors=False),
            "feature-rerank": lambda: self.reranked,
        }
        if mode not in ways:
            raise ValueError(f"unknown mode {mode}")
        return ways[mode]().select("case_id", "key", "rank").filter(F.col("rank") <= self.limit)


class Grid:
    """Modes by blocks of cases, with a ledger: what a run has committed, the next one leaves alone.

    A commit holds the measures of the cases of a block and the ledger's rows together, so a run
    that dies leaves no half of it. A block whose cases changed is measured anew. The store is of
    one state of the documents; another state takes another store.
    """

    def __init__(self, store: Store, cases: DataFrame, blocks: int = 8):
        self.store, self.blocks = store, blocks
        self.cases = cases.withColumn("block", F.pmod(F.hash("case_id"), F.lit(blocks)))

    def digests(self) -> dict[int, int]:
        """A sum of hashes of the cases of each block: one number for each of the blocks."""
        rows = self.cases.groupBy("block").agg(F.sum(F.xxhash64(*[c for c in self.cases.columns if c != "block"]).cast("decimal(38,0)")).alias("d")).collect()
        return {r.block: str(r.d) for r in rows}

    def missing(self, modes: Sequence[str]) -> list[tuple[int, str]]:
        """Blocks and modes that no commit has, in order."""
        held = self.store.version().read("units")
        done = set() if held is None else {(r.block, r.mode, r.digest) for r in held.filter(F.col("mode").isin(list(modes))).collect()}  # blocks x modes
        return [(b, m) for b, d in sorted(self.digests().items()) for m in modes if (b, m, d) not in done]

    def run(self, modes: Sequence[str], search: Callable[[DataFrame], BatchSearch], measure: Callable[[DataFrame, DataFrame], DataFrame], at_most: int | None = None) -> list[tuple[int, str]]:
        """Does what is missing, or the first at_most of it, and returns it.

        search makes a BatchSearch of the cases of a block; measure takes cases and results to rows with a case_id.
        """
        units, digests = self.missing(modes)[:at_most], self.digests()
        for block in sorted({b for b, _ in units}):
            part = self.cases.filter(F.col("block") == block).drop("block")
            engine, out = search(part), None
            for mode in [m for b, m in units if b == block]:
                rows = measure(part, engine.results(mode)).withColumn("mode", F.lit(mode)).withColumn("block", F.lit(block))
                out = rows if out is None else out.unionByName(rows)
            ledger = self.store.spark.createDataFrame([(b, m, digests[b]) for b, m in units if b == block], "block int, mode string, digest string")
            self.store.commit(lambda held, out=out, ledger=ledger: {"measures": self._change(held, settled(out, "measures"), ledger), "units": Change(ledger)}, {"measures": ["mode", "case_id"], "units": ["block", "mode"]})
        return units

    def _change(self, held, rows: DataFrame, ledger: DataFrame) -> Change:
        """Measures of the block, without those of cases that are no longer in it."""
        before = held.read("measures")
        if before is None:
            return Change(rows)
        gone = before.join(F.broadcast(ledger.select("block", "mode")), ["block", "mode"], "left_semi").join(rows.select("mode", "case_id"), ["mode", "case_id"], "left_anti")
        return Change(rows, gone.select("mode", "case_id"))

    def measures(self) -> DataFrame | None:
        return self.store.version().read("measures")


def measured(expected: DataFrame, k: int = 10) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """measure of a Grid: the measures of each case against expectations (case_id, key)."""
    return lambda cases, results: V.per_case(cases.select("case_id"), results, expected.join(cases.select("case_id"), "case_id", "left_semi"), k)
