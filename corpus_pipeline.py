"""From documents to token ids: toxic texts, near copies and leaked test items go, personal data
is replaced, and what is left is encoded.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), with docs what the
stage before it kept, and returns the columns of documents, but for the last, which returns
doc_id, n_tokens and digests of the ids and of the bytes that they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidara.llm import bpe, decontam, neardup, pii, toxicity
from evidara.llm.common import materialize, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labels of documents outside the held-out fold; drops what it predicts toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of texts of 0.8 or more, over shingles of five words."""
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with 0.8 or more of the five-word shingles of an item of benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces spans of personal data in text by their kind; no document goes."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_test_items),
    ("personal_data", without_personal_data),
    ("byte_bpe", encoded),
]

#: The classifiers of the first and fourth stage and the merges of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
