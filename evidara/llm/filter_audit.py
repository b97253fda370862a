"""Interaction of filters: what each removes in every order, from one count of failure masks.

Each document has a mask, one bit for each filter that it fails. Per part, the documents
are counted by mask; the subset-zeta transform turns the counts c[m] into
z[x] = sum of c[m] over all m within x. A set of filters leaves the documents whose mask lies
within the other filters, so survivors of every subset are read from z, and a step of any
order is the difference of two neighbouring subsets. Labels are counted and transformed alike.

Only the count by mask looks at documents: 2^k rows of a part leave it, whatever the part's
size, and map tasks combine before they shuffle.

Defined cases: a null text is an empty one; a null part is the part ''; rows are counted one by
one, repeated ones too; a row without id is no repeat and has no label; several labels of one id
count as any of them; labels of unknown ids count nowhere; an empty table gives no rows; texts
are read whole, and columns other than those named are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
#: Orders of more filters than this are too many to list.
MOST_FILTERS = 7


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A to D: short, repetitive, shouting, or with symbols of markup."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 2 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def counts_by_mask(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail.

    Bit i of mask is filter i; the last filter is E, a text equal to that of a smaller id. Copies of
    a text are first counted by id and then merged by text with their smallest id, so a text that a
    third of all rows share is a few rows for each part before its rows meet.
    """
    masks = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(text_failures(F.col("text")))), F.lit(0))
    of_docs = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_key"),
        masks.cast("int").alias("mask"),
    )
    of_ids = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    same = ["text_key", "part", "mask", "good", "toxic"]
    by_id = of_docs.join(of_ids, "doc_id", "left").select("doc_id", "text_key", "part", "mask", *flags).groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"),
        F.min("doc_id").alias("low"),
        F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_low"),
    )
    first = F.min("low").over(Window.partitionBy("text_key"))
    split = by_text.withColumn("fresh", F.col("without_id") + F.when(F.col("low") == first, F.col("at_low")).otherwise(F.lit(0)))
    repeat = 1 << 4
    both = F.array(F.struct(F.col("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    rows = split.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def subset_sums(counts: np.ndarray) -> np.ndarray:
    """z[..., x] = sum of counts[..., m] over all m within x."""
    k = (counts.shape[-1] - 1).bit_length()
    z = counts.reshape(*counts.shape[:-1], *[2] * k)
    for axis in range(-k, 0):
        z = z.cumsum(axis)
    return z.reshape(counts.shape)


def steps(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, filters applied before, the filter's bit) of every step of every order."""
    out = []
    for order in permutations(range(len(names))):
        before = 0
        for at, i in enumerate(order):
            out.append(("".join(names[j] for j in order), at + 1, before, 1 << i))
            before |= 1 << i
    return out


def measures(counts: np.ndarray, names: str) -> dict[str, np.ndarray]:
    """Each measure by part and step, for counts[part, what, mask] with what all, good, toxic."""
    k, every = len(names), (1 << len(names)) - 1
    z = subset_sums(counts)
    left = z[:, :, ::-1]  # by the filters applied: the mask lies within the others
    plan = steps(names)
    before, bit = np.array([s[2] for s in plan]), np.array([s[3] for s in plan])
    after = before | bit
    lost = left[:, :, before] - left[:, :, after]
    failing = left[:, 0, :1] - left[:, 0, bit]
    share = np.zeros((len(counts), every + 1), np.int64)  # of each filter's bit: removed, over all orders
    for i in range(k):
        for x in range(every + 1):
            if not x >> i & 1:
                used = x.bit_count()
                share[:, 1 << i] += math.factorial(used) * math.factorial(k - 1 - used) * (left[:, 0, x] - left[:, 0, x | 1 << i])
    return {
        "kept": left[:, 0, after],
        "removed": lost[:, 0],
        "redundant": failing - lost[:, 0],
        "unique_fails": left[:, 0, every & ~bit] - left[:, 0, every:],
        "good_lost": lost[:, 1],
        "toxic_lost": lost[:, 2],
        "shapley": share[:, bit],
    }


def order_table(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and the measures, for every part, order and step of the filters named.

    counts: (part, mask, n, good, toxic), at most one row for each part and mask.
    """
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders to list")
    plan = steps(names)
    order, step = pa.array([s[0] for s in plan]), pa.array([s[1] for s in plan], pa.int32())
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((m, pa.int64()) for m in MEASURES)])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            parts = batch.column("part").to_pylist()
            held = np.zeros((len(parts), 3, 1 << len(names)), np.int64)
            for i, entries in enumerate(batch.column("entries").to_pylist()):
                for e in entries:
                    held[i, :, e["mask"]] += (e["n"], e["good"], e["toxic"])
            found = measures(held, names)
            for i, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(plan), pa.string()), order, step, *(pa.array(found[m][i]) for m in MEASURES)], schema=schema)

    of_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))
    return of_part.mapInArrow(apply, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))
