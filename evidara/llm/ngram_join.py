"""N-gram Jaccard join: T-occurrence search over inverted lists, by DivideSkip.

A document with n shingles can only be linked with one that is on T = ceil(percent * n / 100)
of its inverted lists. DivideSkip merges the short lists, whose candidates need only few
occurrences, and looks them up by binary search in the long ones. It is used twice:

- across the cluster, the first n - T + c shingles of a document, in one order for all (that of their
  hashes), are entries of lists keyed by shingle. Those of two linked documents name each other c
  times (c as for the smallest partner that a document can have), so of its entries that anyone shares,
  h, all but the c - 1 in the longest lists must lead to each partner. These longest lists are left
  out, and with fewer than c entries shared a document has no partner and goes. Who is left meets, among
  documents of about its size, all others of a list under the smallest id (its pivot), once,
  however many lists they share;
- documents that meet are indexed by their whole sets, and each searches that index: MergeSkip (a
  heap that leaps over documents with too few occurrences) on the short lists, binary search in the
  long ones, and those that reach the required overlap are linked (divide_skip).

By the pigeonhole principle no link is lost, so links are exact up to equal 64-bit hashes. Documents
with equal sets are one class. What leaves a group is a spanning forest of its links, never its pairs,
and large groups meet their first member before each other (text_links).

Defined cases: null and empty texts, and texts of white space only, have no shingles and are
linked with nothing; a text of fewer words than the width is one shingle; repeated rows are copies;
rows that repeat an id are one document with the links of all its texts; rows without id have a null
component; an empty table gives no rows; texts of any length are read whole. Other columns are not
looked at.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, materialize, slices
from .neardup import _words, classes_of, reached, shingle_set, text_links

#: Longer lists count as of this length, so that a task holds no more of one.
LONGEST = 1 << 16
#: Weight of the length of the longest list in the number of lists that are not merged.
MU = 0.01


def least_overlap(n: int | np.ndarray, percent: int):
    """Shingles that a set of n shares at least with any set that it is linked with."""
    return -(-percent * n // 100)


def required(n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that sets of n and m must share: 100 * both >= percent * (n + m - both)."""
    return -(-percent * (n + m) // (100 + percent))


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(entry, occurrences) of what is on at least so many of these sorted lists.

    The heap holds the front of each list. If the smallest entry is not on enough of them, as
    many lists as could not name it often enough leap to the next front by binary search.
    """
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapify(heap)
    out = []
    while len(heap) >= least:
        entry = heap[0][0]
        taken = []
        while heap and heap[0][0] == entry:
            taken.append(heappop(heap))
        if len(taken) >= least:
            out.append((entry, len(taken)))
            goal = entry + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heappop(heap))
            if not heap:
                break
            goal = heap[0][0]
        for _, k, at in taken:
            at = bisect_left(lists[k], goal, at)
            if at < len(lists[k]):
                heappush(heap, (lists[k][at], k, at))
    return out


def long_lists(least: int, longest: int) -> int:
    """How many lists are left to binary search; the others are merged and need one occurrence at least."""
    return min(least - 1, int(least / (MU * math.log2(max(longest, 2)) + 1)))


def divide_skip(n: int, lists: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """The sets, by their place in sizes, that share what is required with a query of n shingles.

    lists: for each shingle of the query that other sets have, the places of its sets, in order.
    """
    least = int(least_overlap(n, percent))
    if len(lists) < least:
        return np.zeros(0, np.int64)
    lists = sorted(lists, key=len)
    kept_back = long_lists(least, len(lists[-1]))
    short, long = lists[: len(lists) - kept_back], lists[len(lists) - kept_back :]
    merged = merge_skip([x.tolist() for x in short], least - kept_back)
    if not merged:
        return np.zeros(0, np.int64)
    at, both = (np.array(x, np.int64) for x in zip(*merged))
    need = required(n, sizes[at], percent)
    for k, entries in enumerate(long):
        place = np.minimum(np.searchsorted(entries, at), len(entries) - 1)
        both += entries[place] == at
        open_ = both + (len(long) - k - 1) >= need
        if not open_.all():
            at, both, need = at[open_], both[open_], need[open_]
            if not len(at):
                break
    return at[both >= need]


def linked_sets(nodes: list, sets: list[np.ndarray], percent: int, joined: np.ndarray | None = None) -> list[tuple]:
    """A spanning forest of the links among these sets; those marked joined are known to be connected."""
    sizes = np.array([len(s) for s in sets], np.int64)
    shingle = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(shingle, kind="stable")  # owners of a shingle stay in order
    shingle, owner = shingle[by], owner[by]
    new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(shingle))
    values = shingle[starts]
    label = np.arange(len(sets))
    order = sorted(range(len(sets)), key=lambda i: (nodes[i], sizes[i]))
    if joined is not None and joined.any():
        label[joined] = np.flatnonzero(joined)[0]
        order = [i for i in order if not joined[i]]
    links = []
    for i in order:
        if (label == label[i]).all():
            break
        mine = np.searchsorted(values, sets[i])
        mine = mine[ends[mine] - starts[mine] > 1]
        for j in divide_skip(int(sizes[i]), [owner[starts[v] : ends[v]] for v in mine], sizes, percent).tolist():
            if label[j] != label[i]:
                if nodes[i] != nodes[j]:
                    links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                label[label == label[j]] = label[i]
    return links


_FEATURES = "doc_id long, text_key long, n_shingles long, fp binary, first array<long>"


def _features(width: int, percent: int):
    """Of each document, the first n - T + c shingles by hash, with c = n - T + 1: none if only equal sets can be linked with it."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("first", pa.list_(pa.int64()))])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", _words.clear)
        for batch in slices(batches):
            sizes, fps, firsts = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                n = len(s)
                sizes.append(n)
                fps.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                # A set that another one differs from shares at most n of n + 1.
                able = n and 100 * n >= percent * (n + 1)
                firsts.append(s[: 2 * (n - least_overlap(n, percent)) + 1].view(np.int64) if able else s[:0].view(np.int64))
            made = (pa.array(x, f.type) for x, f in zip((sizes, fps, firsts), list(schema)[2:]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *made], schema=schema)

    return apply


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (class, shingle), sorted by shingle, of lists with more than one, with the length of their list."""

    def out(classes: np.ndarray, shingles: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"class": classes, "shingle": shingles, "size": sizes.astype(np.int32)})

    held: list[np.ndarray] = []
    last, count, long = None, 0, False

    def done() -> Iterator[pa.RecordBatch]:
        if count > 1 and not long:
            classes = np.concatenate(held)
            yield out(classes, np.full(count, last, np.int64), np.full(count, count))

    for batch in batches:
        if not batch.num_rows:
            continue
        classes, shingles = (batch.column(c).to_numpy() for c in ("class", "shingle"))
        edges = np.concatenate([[0], np.flatnonzero(shingles[1:] != shingles[:-1]) + 1, [len(shingles)]])
        if shingles[0] != last:
            yield from done()
            held, last, count, long = [], shingles[0], 0, False
        # The first run goes on from the batch before; the last one may go on in the next.
        inner = slice(edges[1], edges[-2]) if len(edges) > 2 else slice(0, 0)
        for at, (a, b) in enumerate([(edges[0], edges[1]), (edges[-2], edges[-1])][: min(2, len(edges) - 1)]):
            if at == 1:
                yield from done()
                held, last, count, long = [], shingles[a], 0, False
            mine = classes[a:b]
            if not long and count + len(mine) > LONGEST:
                mine, held, long = np.concatenate([*held, mine]), [], True
            if long:
                yield out(mine, np.full(len(mine), last, np.int64), np.full(len(mine), LONGEST))
            else:
                held.append(mine)
            count += b - a
        sizes = np.diff(edges[1:-1])
        if len(sizes):
            sizes = np.repeat(np.minimum(sizes, LONGEST), sizes)
            some = sizes > 1
            yield out(classes[inner][some], shingles[inner][some], sizes[some])
    yield from done()


def size_bounds(percent: int, most: int) -> list[int]:
    """Where classes of sizes begin, so that linked sets are in the same class or in neighbouring ones."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(100 * bounds[-1] // percent + 1)
    return bounds


def _meetings(reps: DataFrame, percent: int) -> DataFrame:
    """(pivot, rep, fp, n_shingles): classes that share a list that they need, under the smallest id of those of about their size."""
    held = reps.filter(F.size("first") > 0).withColumn("class", F.xxhash64("rep", "fp"))
    entries = held.select("class", F.explode("first").alias("shingle"))
    shared = entries.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_shared, "class long, shingle long, size int")
    lists = shared.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("size", "shingle"))).alias("lists"))
    # A partner may be smaller, with T shingles at least; then it and this one name each other this often.
    least = F.floor((100 - percent) * F.ceil(percent * F.col("n_shingles") / 100) / 100).cast("int") + 1
    left = held.select("class", "rep", "fp", "n_shingles").join(lists.filter("size(lists) > 0"), "class").withColumn("over", F.size("lists") - least).filter("over >= 0")
    left = materialize(left.select("rep", "fp", "n_shingles", F.slice("lists.shingle", F.lit(1), F.col("over") + 1).alias("lists")), "able")

    most = left.agg(F.max("n_shingles")).first()[0] or 1
    bounds = F.array(*(F.lit(b).cast("long") for b in size_bounds(percent, most)))
    size_class = F.size(F.filter(bounds, lambda b: b <= F.col("n_shingles")))
    entries = left.withColumn("k", F.explode(F.array(size_class, size_class - 1))).select("rep", "fp", "n_shingles", "k", F.explode("lists").alias("shingle"))
    pivots = entries.groupBy("shingle", "k").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return materialize(entries.join(pivots, ["shingle", "k"]).select("pivot", "rep", "fp", "n_shingles").distinct(), "meetings")


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Rows are linked where 100 * shared >= percent * union of their distinct shingles of width
    words; component_id is the smallest id that links reach.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50, up to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    feats = materialize(docs.mapInArrow(_features(width, percent), _FEATURES), "features")
    classes, reps = classes_of(feats)
    links = text_links(docs, _meetings(reps, percent), width, percent, linked_sets)
    rows = reached(feats, classes, links, by_id=True)
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("first_rep")).alias("component_id"))
