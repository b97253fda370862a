"""Merkle manifest of a dataset: leaves, subroots per source, a root, and proofs of every row.

Each row is a leaf; the leaves of a source, by id, are the bottom of a tree in which every three
consecutive nodes become one, and the subroots, by source, are the bottom of the tree on top.

Leaves are sorted in ranges. What a range can settle of its trees it settles; what is left
is a sparse forest: unresolved nodes keyed by tree, level and index, of which a range has no
more than some at each end of each level. Forests form a monoid: merging two takes both
their nodes, and wherever all siblings of a run are there (how many is known from the number of
leaves), they become their parent. treeReduce merges the forests of all ranges; the root is the
last node. The nodes of the forests, O(ranges x levels), are all that a range does not know
itself, so they go to every task, which gives the proofs of its rows. Ranges are at most
MOST_RANGES, so neither the driver nor a task holds more than that, whatever the number of rows.

Defined cases: null fields are `-`; null sources come first, as a source of their own; null ids
come first; rows that repeat an id are ordered by their leaf, and each is a leaf; empty texts are
`0:`; texts are read whole; a lone leaf is its subroot, a lone subroot the root; an empty table
has no rows and no root. Columns other than the fields are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, runs

ARITY = 3
#: Leaves of a range, up to MOST_RANGES ranges; then ranges grow.
LEAVES, MOST_RANGES = 50_000, 4096
#: The tree over the subroots; trees of sources are named by their rank.
TOP = -1
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

Key = tuple[int, int, int]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(field: Column) -> Column:
    """A field with its length in bytes, so that no two rows give the same text."""
    text = field.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def level_sizes(n: int) -> list[int]:
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def settle(digests: list[str], start: int, total: int) -> tuple[list[tuple[int, list[str]]], dict[tuple[int, int], str]]:
    """Of consecutive leaves of a tree with total leaves: (first index, nodes) of each level that
    follow from them alone, and the nodes, by level and index, whose parents do not. The root, if
    it follows, is the only node of the last level and unresolved."""
    levels, unresolved = [(start, digests)], {}
    sizes = level_sizes(total)
    for level, size in enumerate(sizes):
        first, nodes = levels[level]
        if not nodes:
            break
        if size == 1:
            unresolved[level, 0] = nodes[0]
            break
        end = first + len(nodes)
        low = -(-first // ARITY)
        high = -(-end // ARITY) if end == size else end // ARITY
        high = max(high, low)
        inside = range(low * ARITY, min(high * ARITY, end)) if high > low else range(0)
        for i in range(first, end):
            if i not in inside:
                unresolved[level, i] = nodes[i - first]
        levels.append((low, [digest("".join(nodes[r * ARITY - first : min((r + 1) * ARITY, end) - first])) for r in range(low, high)]))
    return levels, unresolved


class Forest(NamedTuple):
    """Nodes whose parents are not known yet, and the children of those that became known here."""

    unresolved: dict[Key, str]
    settled: dict[Key, str]


def grow(forest: Forest, totals: dict[int, int]) -> Forest:
    """Every complete run of siblings becomes its parent, up to the roots of sources and on."""
    nodes, settled = dict(forest.unresolved), dict(forest.settled)
    sizes = {tree: level_sizes(totals[tree]) for tree in {k[0] for k in nodes} | {TOP}}
    todo = list(nodes)
    while todo:
        key = todo.pop()
        if key not in nodes:
            continue
        tree, level, index = key
        size = sizes[tree][level]
        if size == 1:
            if tree == TOP:
                continue
            parent, value = (TOP, 0, tree), nodes[key]
            settled[key] = nodes.pop(key)
        else:
            run = [(tree, level, i) for i in range(index // ARITY * ARITY, min(size, (index // ARITY + 1) * ARITY))]
            if not all(k in nodes for k in run):
                continue
            value = digest("".join(nodes[k] for k in run))
            settled |= {k: nodes.pop(k) for k in run}
            parent = (tree, level + 1, index // ARITY)
        nodes[parent] = value
        todo.append(parent)
    return Forest(nodes, settled)


def merge(a: Forest, b: Forest, totals: dict[int, int]) -> Forest:
    """Associative and commutative; the empty forest is its neutral element."""
    return grow(Forest(a.unresolved | b.unresolved, a.settled | b.settled), totals)


class Layout(NamedTuple):
    """Where ranges begin: by range the rank of its first source and the leaves of it before; the
    leaves of the sources at the ends of ranges, by rank, and under TOP the number of sources."""

    begins: dict[int, tuple[int, int]]
    totals: dict[int, int]


class Manifest(NamedTuple):
    rows: DataFrame
    ranges: int
    layout: Layout
    forest: Forest

    @property
    def root(self) -> str | None:
        top = len(level_sizes(self.layout.totals[TOP])) - 1 if self.layout.totals[TOP] else 0
        return self.forest.unresolved.get((TOP, top, 0))


def _ranged(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Leaves in sorted ranges: range, place in it. A source or id with very many rows spans several."""
    leaves = materialize(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    ranges = max(1, min(MOST_RANGES, -(-leaves.count() // LEAVES)))
    order = ["source", "doc_id", "leaf", "tie"]
    placed = leaves.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("tie")
    placed = placed.withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    return materialize(placed, "ranges"), ranges


def _layout(rows: DataFrame) -> Layout:
    """From one line for each range: its sources, and rows of the first and the last one."""
    key = F.struct(F.col("source").isNotNull().alias("some"), "source", "n")
    of_range = rows.groupBy("range", "source").agg(F.count("*").alias("n")).groupBy("range").agg(F.count("*").alias("sources"), F.min(key).alias("low"), F.max(key).alias("high"))
    begins, totals = {}, {}
    last, rank, reached = None, -1, 0
    for r in sorted(of_range.collect(), key=lambda r: r["range"]):
        low, high = (r["low"]["some"], r["low"]["source"]), (r["high"]["some"], r["high"]["source"])
        if low != last:
            rank, reached = rank + 1, 0
        begins[r["range"]] = (rank, reached)
        totals[rank] = reached + r["low"]["n"]
        if r["sources"] > 1:
            rank += r["sources"] - 1
            totals[rank] = r["high"]["n"]
        last, reached = high, totals[rank]
    totals[TOP] = rank + 1
    return Layout(begins, totals)


def _trees(layout: Layout, at: int, sources: list[str | None], leaves: list[str]):
    """Of a range: (rank, first index, total, from, to) of each source, and all that follows of its trees."""
    edges = [0, *(i for i in range(1, len(sources)) if sources[i] != sources[i - 1]), len(sources)]
    rank, reached = layout.begins[at]
    segments, levels, unresolved, done = [], {}, {}, {}
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        start = reached if k == 0 else 0
        total = layout.totals.get(rank + k, b - a)
        segments.append((rank + k, start, total, a, b))
        levels[rank + k], rest = settle(leaves[a:b], start, total)
        top = len(level_sizes(total)) - 1
        if (top, 0) in rest:
            done[rank + k] = rest.pop((top, 0))
        unresolved |= {(rank + k, *key): v for key, v in rest.items()}
    if done:
        first = min(done)
        levels[TOP], rest = settle([done[i] for i in range(first, first + len(done))], first, layout.totals[TOP])
        unresolved |= {(TOP, *key): v for key, v in rest.items()}
    return segments, levels, unresolved


def _by_range(rows: DataFrame, ranges: int) -> DataFrame:
    return rows.repartition(ranges, "range").sortWithinPartitions("range", "place")


def build(leaves: DataFrame) -> Manifest:
    """The manifest of leaves (doc_id, source, leaf, ...), whose further columns stay with their rows."""
    rows, ranges = _ranged(leaves)
    layout = _layout(rows)

    def forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at,), parts in runs(batches, ["range"]):
            t = pa.Table.from_batches(parts)
            _, _, nodes = _trees(layout, at, t.column("source").to_pylist(), t.column("leaf").to_pylist())
            tree, level, index = zip(*nodes)
            yield pa.RecordBatch.from_pydict({"tree": pa.array(tree, pa.int64()), "level": pa.array(level, pa.int32()), "index": pa.array(index, pa.int64()), "digest": pa.array(nodes.values(), pa.string())})

    if not layout.begins:
        return Manifest(rows, ranges, layout, Forest({}, {}))
    nodes = _by_range(rows.select("range", "place", "source", "leaf"), ranges).mapInArrow(forests, "tree long, level int, index long, digest string")
    nodes = materialize(nodes, "forest")
    totals = layout.totals
    forest = nodes.rdd.mapPartitions(lambda part: [grow(Forest({(r[0], r[1], r[2]): r[3] for r in part}, {}), totals)]).treeReduce(lambda a, b: merge(a, b, totals))
    return Manifest(rows, ranges, layout, forest)


class _Sight:
    """Nodes of all trees as one range sees them: its own, and those of the merged forest."""

    def __init__(self, layout: Layout, levels: dict, far: dict[Key, str]):
        self.layout, self.levels, self.far = layout, levels, far
        self.total = dict(layout.totals)
        self.above: dict[tuple[bool, int], tuple[int, int, str]] = {}
        self.sizes: dict[int, list[int]] = {}

    def size(self, tree: int) -> list[int]:
        total = self.total[tree]
        if total not in self.sizes:
            self.sizes[total] = level_sizes(total)
        return self.sizes[total]

    def node(self, tree: int, level: int, index: int) -> str:
        own = self.levels.get(tree, ())
        if level < len(own) and 0 <= index - own[level][0] < len(own[level][1]):
            return own[level][1][index - own[level][0]]
        return self.far[tree, level, index]

    def siblings(self, tree: int, level: int, index: int) -> tuple[str, str]:
        """The others of the node's run, before it and after it."""
        first = index // ARITY * ARITY
        end = min(self.size(tree)[level], first + ARITY)
        return "".join(self.node(tree, level, i) for i in range(first, index)), "".join(self.node(tree, level, i) for i in range(index + 1, end))

    def parent(self, tree: int, level: int, index: int) -> Key | None:
        if self.size(tree)[level] > 1:
            return tree, level + 1, index // ARITY
        return None if tree == TOP else (TOP, 0, tree)

    def path(self, tree: int, level: int, index: int) -> str:
        """All siblings from a node's run up to the root; rows come in order, so one node a level is kept."""
        slot = (tree == TOP, level)
        kept = self.above.get(slot)
        if kept and kept[:2] == (tree, index):
            return kept[2]
        own = "".join(self.siblings(tree, level, index)) if self.size(tree)[level] > 1 else ""
        up = self.parent(tree, level, index)
        text = own + (self.path(*up) if up else "")
        if level or tree == TOP:
            self.above[slot] = (tree, index, text)
        return text

    def folded(self, value: str, tree: int, level: int, index: int) -> str:
        """The root that follows from another value of a node and the siblings as they are."""
        at: Key | None = (tree, level, index)
        while at:
            if self.size(at[0])[at[1]] > 1:
                left, right = self.siblings(*at)
                value = digest(left + value + right)
            at = self.parent(*at)
        return value


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of the manifest.

    folded_root is folded from the row's column claimed, a leaf as it is found now, and from leaf where that is null.
    """
    layout, root = manifest.layout, manifest.root
    known = manifest.rows.sparkSession.sparkContext.broadcast(manifest.forest.settled | manifest.forest.unresolved)
    text = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in text), ("verified", pa.bool_())])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at,), parts in runs(batches, ["range"]):
            t = pa.Table.from_batches(parts)
            leaves, claimed = t.column("leaf").to_pylist(), t.column("claimed").to_pylist()
            segments, levels, _ = _trees(layout, at, t.column("source").to_pylist(), leaves)
            sight = _Sight(layout, levels, known.value)
            for rank, start, total, a, b in segments:
                sight.total[rank] = total
                subroot = sight.node(rank, len(sight.size(rank)) - 1, 0) if total > 1 else leaves[a]
                for low in range(a, b, 4096):
                    high = min(b, low + 4096)
                    proof, folded = [], []
                    for i in range(low, high):
                        place = (rank, 0, start + i - a)
                        proof.append(digest(sight.path(*place)))
                        folded.append(sight.folded(leaves[i] if claimed[i] is None else claimed[i], *place))
                    n = high - low
                    columns = [pa.array(c, pa.string()) for c in (leaves[low:high], [subroot] * n, [root] * n, proof, folded)]
                    ids = t.column("doc_id").slice(low, n).combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids, *columns, pa.array([f == root for f in folded], pa.bool_())], schema=schema)

    rows = _by_range(manifest.rows.select("range", "place", F.col("doc_id").cast("long").alias("doc_id"), "source", "leaf", "claimed"), manifest.ranges)
    return rows.mapInArrow(apply, "doc_id long, " + ", ".join(f"{c} string" for c in text) + ", verified boolean")


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf and claimed (the leaf with the line feeds of its text deleted, where tampered) of documents."""
    cols = [F.col(f) for f in FIELDS]
    bare = F.replace("text", F.lit("\n"), F.lit(""))
    claimed = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf_of([*cols[:-1], bare]))
    return docs.select("doc_id", "source", leaf_of(cols).alias("leaf"), claimed.alias("claimed"))
