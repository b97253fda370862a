"""Lexical retrieval: phrase containment, BM25 in one pass, weighted chunk fields, term fallback, trigram postings.

A phrase of a trigram index is a substring without regard to case, so containment is the
match and its hits are term frequencies. Statistics (rows, mean length, rows with a match)
come from one aggregate over the searched rows, one row that is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_of
from ..sources.scratch import settled
from .lexical_index import LexicalIndex

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def trigrams(c: Column) -> Column:
    """Number of trigrams of a text."""
    return F.greatest(F.length(c) - 2, F.lit(0))


def bm25(df: DataFrame, phrase: str, weights: Mapping[str, float]) -> DataFrame:
    """Rows with the phrase in one of the columns, with a score (higher is better).

    weights gives each searched column a factor for its hits; length counts all of them.
    """
    hits = reduce(lambda a, b: a + b, [count_of(F.coalesce(F.col(c), F.lit("")), phrase) * w for c, w in weights.items()])
    size = reduce(lambda a, b: a + b, [trigrams(F.coalesce(F.col(c), F.lit(""))) for c in weights])
    d = df.withColumn("__tf", hits).withColumn("__len", size)
    stats = d.agg(F.count("*").alias("__rows"), F.avg("__len").alias("__avg"), F.count_if(F.col("__tf") > 0).alias("__with"))
    idf = F.greatest(F.log((F.col("__rows") - F.col("__with") + 0.5) / (F.col("__with") + 0.5)), F.lit(LEAST_IDF))
    tf = F.col("__tf")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    return d.filter("__tf > 0").join(F.broadcast(stats)).withColumn("score", score).drop("__tf", "__len", "__rows", "__avg", "__with")


def bm25_indexed(index: LexicalIndex, df: DataFrame, phrase: str, weights: Mapping[str, float]) -> DataFrame:
    """As bm25, with the statistics of a kept index and the rows that it names; df has the index's key and fields.

    Columns of the result are the key and score. Hits are counted once and written, since
    their number is needed before any score.
    """
    names = list(weights)
    hits = reduce(lambda a, b: a + b, [count_of(F.coalesce(F.col(c), F.lit("")), phrase) * w for c, w in weights.items()])
    live = index.live()
    size = reduce(lambda a, b: a + b, [F.greatest(F.col(f"len_{c}") - 2, F.lit(0)) for c in names])
    rows = index.narrowed(df, [phrase]).select(F.col(index.key).alias("key"), hits.alias("__tf")).filter("__tf > 0")
    found = settled(rows.join(live.select("key", size.alias("__len")), "key"), "hits")
    stats = live.agg(F.count("*").alias("__rows"), F.avg(size).alias("__avg")).join(F.broadcast(found.agg(F.count("*").alias("__with"))))
    idf = F.greatest(F.log((F.col("__rows") - F.col("__with") + 0.5) / (F.col("__with") + 0.5)), F.lit(LEAST_IDF))
    tf = F.col("__tf")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    return found.join(F.broadcast(stats)).select(F.col("key").alias(index.key), score.alias("score"))


def title_tier(title: Column, content: Column, phrase: str) -> Column:
    p = phrase.lower()
    return F.when(F.lower(title).contains(p), 0).when(F.lower(content).contains(p), 1).otherwise(2)


def all_terms(df: DataFrame, terms: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with every term in some column."""
    anywhere = lambda t: reduce(lambda a, b: a | b, [F.lower(c).contains(t.lower()) for c in columns])
    return df.filter(reduce(lambda a, b: a & b, [anywhere(t) for t in terms]))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of first, or those of second where first has none; decided in the plan."""
    empty = first.agg((F.count("*") == 0).alias("__empty"))
    return first.unionByName(second.join(F.broadcast(empty.filter("__empty")).drop("__empty")))


def grams_of(phrase: str) -> list[str]:
    p = phrase.lower()
    return sorted({p[i : i + 3] for i in range(len(p) - 2)})


def trigram_postings(df: DataFrame, key: str, column: str, only: Sequence[str] | None = None) -> DataFrame:
    """(key, gram) of the distinct trigrams of each row, or of those of a stated list."""
    # Characters zipped with their neighbours take linear time; a substring for each place would be quadratic.
    c = F.split(F.lower(column), "")
    n = F.greatest(F.size(c) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda x, y: F.concat(x, y))
    grams = F.array_distinct(F.zip_with(pairs, F.slice(c, 3, n), lambda x, y: F.concat(x, y)))
    if only is not None:
        grams = F.array_intersect(grams, F.array(*map(F.lit, only)).cast("array<string>"))
    return df.select(F.col(key), F.explode(grams).alias("gram"))


def by_postings(df: DataFrame, postings: DataFrame, key: str, column: str, phrase: str) -> DataFrame:
    """Rows with the phrase: those that have all its trigrams, then verified by containment."""
    grams = grams_of(phrase)
    have = postings.filter(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") == len(grams)).select(key)
    return df.join(have, key, "left_semi").filter(F.lower(column).contains(phrase.lower()))


def chunk_count(text: Column, size: int = 900, stride: int = 780) -> Column:
    """The number of overlapping chunks of a text."""
    return F.greatest(F.ceil((F.length(text) - (size - stride)) / F.lit(stride)).cast("int"), F.lit(1))


def chunk_array(text: Column, size: int = 900, stride: int = 780) -> Column:
    """The overlapping chunks of a text, in one pass over it: pieces of stride characters, each with the head of the next."""
    if size > 2 * stride:
        raise ValueError("a chunk reaches into the next piece only")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    n = chunk_count(text, size, stride)
    pairs = F.arrays_zip(pieces.alias("piece"), F.concat(F.slice(pieces, 2, F.size(pieces)), F.array(F.lit(""))).alias("next"))
    joined = F.transform(F.slice(pairs, F.lit(1), n), lambda p: F.concat(p["piece"], F.substring(p["next"], 1, size - stride)))
    return F.when(F.length(text) > stride, joined).otherwise(F.array(text))


def fixed_chunks(df: DataFrame, key: str, column: str, size: int = 900, stride: int = 780) -> DataFrame:
    """Overlapping chunks of whole texts: chunk_index, chunk, and `key#chunk-i` as citation.

    The text itself is carried along only where it is asked for.
    """
    c = df.select("*", F.posexplode(chunk_array(F.col(column), size, stride)).alias("chunk_index", "chunk"))
    return c.withColumn("citation", F.concat(F.col(key).cast("string"), F.lit("#chunk-"), F.col("chunk_index").cast("string")))
