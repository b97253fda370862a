"""Benchmark decontamination: short test items found inside documents of any length.

Containment, not similarity, is what a short item in a long document has, so the items
are the indexed side. They are parted by size; in each size class an item is
stood for by the smallest hashes of its shingles (a bottom-k MinHash sketch), as many as
make it certain that a document with the asked share of the item has one of them: with
n shingles of which a share t must be there, any n - ceil(t n) + 1 suffice, and the class
takes those of its largest size. Windows of documents that meet a sketch name candidates,
and each candidate is confirmed by counting all shingles of the item in the document. No
candidate is lost, whatever the document's length.

Items go to the tasks in blocks of a bounded number of shingles, one block at a time where
there are several: its matches are written, and its memory is given back, before the next
is read. Documents are read once for each block and are never shuffled.

Words are runs of letters, digits and underscores in the lower-cased text. Defined cases:
null texts, and texts without a word, match nothing; items shorter than the width are one
shingle of their own length; repeated items count once and repeated documents each; null
ids are kept in the result; an empty table on either side gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, materialize, slices

#: Shingles of items that go to the tasks at once.
BLOCK_SHINGLES = 1_000_000
WORD_CACHE = 150_000
_WORD = re.compile(r"\w+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.full(n, width, np.uint64)
    for i in range(width):
        s = (s ^ (s >> np.uint64(29))) * _A + h[i : i + n]
    s ^= s >> np.uint64(32)
    s *= _B
    return s ^ (s >> np.uint64(29))


def sketch_size(n: int, percent: int) -> int:
    return n - math.ceil(percent * n / 100) + 1


class ItemIndex:
    """Sketches of a block of items by size class, with their whole sets for confirmation."""

    def __init__(self, items: list[tuple[int | None, np.ndarray, int]], percent: int):
        self.percent = percent
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, s, _ in items]
        self.widths = sorted({w for _, _, w in items})
        by_class: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, (_, s, w) in enumerate(items):
            by_class[w, (len(s) - 1).bit_length()].append(k)
        self.named: dict[int, dict[int, list[int]]] = {w: defaultdict(list) for w in self.widths}
        for (w, _), members in by_class.items():
            size = sketch_size(max(len(self.sets[k]) for k in members), percent)
            for k in members:
                for h in self.sets[k][:size].tolist():  # sets are sorted, so these are the smallest
                    self.named[w][h].append(k)
        entries = max((len(x) for x in self.named.values()), default=0)
        self.bits = min(26, max(16, entries.bit_length() + 6))
        self.seen = {}
        for w, named in self.named.items():
            flags = np.zeros(1 << self.bits, bool)
            flags[np.fromiter(named, np.uint64, len(named)) >> np.uint64(64 - self.bits)] = True
            self.seen[w] = flags

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item id, its shingles, those in the text) of each item contained to the asked share."""
        h = word_hashes(text)
        out = []
        for w in self.widths:
            s = windows(h, w)
            near = s[self.seen[w][s >> np.uint64(64 - self.bits)]]
            if not len(near):
                continue
            named = self.named[w]
            candidates = {k for x in set(near.tolist()) for k in named.get(x, ())}
            if not candidates:
                continue
            own = np.unique(s)
            for k in sorted(candidates):
                item = self.sets[k]
                at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                both = int((own[at] == item).sum())
                if 100 * both >= self.percent * len(item):
                    out.append((self.ids[k], len(item), both))
        return out


def _item_sets(width: int):
    schema = pa.schema([("item_id", pa.int64()), ("width", pa.int32()), ("n", pa.int64()), ("set", pa.binary())])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("decontam", _hashes.clear)
        for batch in slices(batches):
            ids, widths, sets = [], [], []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                h = word_hashes(text)
                if len(h):
                    ids.append(i)
                    widths.append(min(width, len(h)))
                    sets.append(np.unique(windows(h, widths[-1])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return apply


def _item_blocks(items: DataFrame, width: int) -> Iterator[tuple[list, bool]]:
    """(item_id, set, width) in blocks of about BLOCK_SHINGLES shingles, and whether there are several. The driver holds one at a time."""
    sets = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().mapInArrow(_item_sets(width), "item_id long, width int, n long, set binary")
    total = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    if blocks > 1:
        sets = materialize(sets, "items")
    for block in range(blocks):
        held = sets.filter(F.pmod(F.xxhash64("item_id", "set"), F.lit(blocks)) == block).toLocalIterator()
        yield [(r["item_id"], np.frombuffer(bytes(r["set"]), np.uint64), r["width"]) for r in held], blocks > 1


def find_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) wherever a document of docs (doc_id, text)
    has at least percent of the distinct shingles of an item of items (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())])
    out = None
    for block, several in _item_blocks(items, width):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def apply(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hold("decontam", _hashes.clear)
            index = ItemIndex(sent.value, percent)
            for batch in slices(batches):
                rows = [(i, *m) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in index.matches(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], schema=schema)

        found = docs.mapInArrow(apply, "doc_id long, item_id long, n_item long, n_shared long")
        if several:
            found = materialize(found, "matches")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, without the rows whose text contains an item. Rows are judged one by one, without a shuffle."""
    for block, several in _item_blocks(items, width):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def apply(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hold("decontam", _hashes.clear)
            index = ItemIndex(sent.value, percent)
            for batch in slices(batches):
                yield batch.filter(pa.array([not index.matches(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(apply, docs.schema)
        if several:
            docs = materialize(docs, "clean")
            sent.destroy()
    return docs
