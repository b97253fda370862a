"""A set of cases looked up in all documents: by their rarest words, and by containment of all their words.

Documents meet cases by equal words only, and only by words that some case has, which are
counted once (term_table). Nothing of the case set goes through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .lexical import B, K1, LEAST_IDF


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]++"), F.lit(0))


def as_sequence(c: Column) -> Column:
    """Words between single spaces, so that containment of one sequence in another is containment of whole words."""
    return F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))


def worded(docs: DataFrame) -> DataFrame:
    """(key, words) of documents (key, text), cut once; what takes documents here takes these in their place."""
    return settled(docs.select("key", words(F.col("text")).alias("words")), "words")


def words_of(docs: DataFrame) -> Column:
    """The words of documents: those of worded, or cut of their texts."""
    return F.col("words") if "words" in docs.columns else words(F.col("text"))


def term_table(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """(key, size, word, tf) of the words of documents (key, text) that some case (case_id, text) has."""
    asked = cases.select(F.explode(words(F.col("text"))).alias("word")).distinct()
    d = docs.select("key", words_of(docs).alias("w")).select("key", F.size("w").alias("size"), F.explode("w").alias("word"))
    return settled(d.join(asked, "word", "left_semi").groupBy("key", "size", "word").agg(F.count("*").alias("tf")), "terms")


def frequencies(cases: DataFrame, table: DataFrame) -> DataFrame:
    """(case_id, word, df) of the distinct words of each case that some document has."""
    df = table.groupBy("word").agg(F.count("*").alias("df"))
    return cases.select("case_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(df, "word")


def rarest(cases: DataFrame, table: DataFrame, most: int) -> DataFrame:
    """(case_id, word, df): the words of each case that the fewest documents have, up to most."""
    own = frequencies(cases, table)
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("df", "word"))
    return own.withColumn("n", n).filter(F.col("n") <= most).drop("n")


def ranked_by_terms(docs: DataFrame, table: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(case_id, key, score, rank): the k best documents of each case by BM25 over its terms."""
    stats = docs.agg(F.count("*").alias("rows"), F.avg(F.size(words_of(docs))).alias("mean"))
    j = table.join(terms, "word").join(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    s = j.groupBy("case_id", "key").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "key"))
    return s.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def fused(modes: list[tuple[float, DataFrame]], k: int) -> DataFrame:
    """(case_id, key, score, rank) by reciprocal ranks of weighted modes."""
    parts = [m.select("case_id", "key", (F.lit(w) / (60 + F.col("rank"))).alias("c")) for w, m in modes]
    s = reduce(lambda a, b: a.unionByName(b), parts).groupBy("case_id", "key").agg(F.round(F.sum("c"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "key"))
    return s.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def containing(docs: DataFrame, cases: DataFrame, table: DataFrame) -> DataFrame:
    """(case_id, key) wherever a document has all words of a case in a row.

    Such a document has the rarest word of the case, so only these two meet, and are compared whole.
    Cases without words are in no document.
    """
    known = cases.select("case_id", F.size(F.array_distinct(words(F.col("text")))).alias("n")).filter("n > 0")
    all_ = frequencies(cases, table).groupBy("case_id").agg(F.count("*").alias("found"), F.min(F.struct("df", "word")).alias("r"))
    anchors = all_.join(known, "case_id").filter("found = n").select("case_id", F.col("r.word").alias("word"))
    pairs = table.select("key", "word").join(anchors, "word").select("case_id", "key")
    j = pairs.join(docs.select("key", as_sequence(words_of(docs)).alias("d")), "key").join(cases.select("case_id", as_sequence(words(F.col("text"))).alias("c")), "case_id")
    return j.filter(F.col("d").contains(F.col("c"))).select("case_id", "key")
