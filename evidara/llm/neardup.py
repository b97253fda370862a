"""Near-duplicate groups: MinHash bands, odd sketches, exact confirmation.

Documents with equal shingle sets are one class, met by its smallest id. MinHash
bands put classes in buckets; in a bucket, odd sketches (parity bitmaps of the
MinHash samples, whose XOR counts the differing samples) tell which members have a
near neighbour at all. Those members meet once per pivot, the smallest id of their
bucket, where shared shingles are counted on full sets. What leaves a group is a
spanning forest of its links, never its pairs. In buckets and groups above a size, all
members are first held against one of them; those near it need not meet each other
again, so only the others are dealt, block by block, to pairs with everyone. Connected
components follow by alternating star steps.

Chance of losing a link at the threshold: bands miss a pair of similarity 0.8 with
probability (1 - 0.8^4)^32 < 5e-8, the sketch with less than 1e-7.

Defined cases: null and empty texts, and texts of white space only, have no shingles
and are linked with nothing; texts shorter than the width are one shingle; rows without
id have a null component and are kept. Rows that repeat an id are one document: in
near_duplicates, the links of all their texts are its links, so they share a component.
In drop_near_duplicates each text counts for itself, so no text is lost for the sake of
another one under the same id. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, hold, materialize, reduce_by_ids, runs, slices

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
#: Rows of a bucket, and shingles of a pivot's group, that meet in one task; of larger ones, what is not near their first member is met by pairs of blocks.
BUCKET_BLOCK, GROUP_BLOCK = 4096, 100_000
#: Words whose hash a task keeps at most.
WORD_CACHE = 150_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_rng = np.random.default_rng(20240601)
_A = _rng.integers(1, 1 << 62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_SAMPLE_SALT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_BAND_SALT = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    s = np.zeros(n, np.uint64)
    for i in range(width):
        s = (s ^ (s >> np.uint64(29))) * _MIX[i % 5] + h[i : i + n]
    s ^= s >> np.uint64(32)
    s *= _MIX[0]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def minhashes(s: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(low, (_A[:, None] * s[at : at + 1024] + _B[:, None]).min(axis=1), out=low)
    return low


def band_keys(m: np.ndarray) -> np.ndarray:
    m = m.reshape(BANDS, ROWS)
    k = _BAND_SALT.copy()
    for i in range(ROWS):
        k = (k ^ (k >> np.uint64(31))) * _MIX[i] + m[:, i]
    k ^= k >> np.uint64(32)
    k *= _MIX[4]
    k ^= k >> np.uint64(29)
    return k.view(np.int64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Each sample flips one bit; equal samples of two texts flip the same bit, so the XOR keeps the others."""
    x = (m ^ _SAMPLE_SALT) * _MIX[0]
    x ^= x >> np.uint64(32)
    x *= _MIX[1]
    odd = np.bincount((x >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_limit(percent: int, samples: int = SAMPLES, bits: int = SKETCH_BITS, sigmas: float = 5.7) -> int:
    """Most differing bits of two sketches at similarity percent / 100, up to chance under 1e-7."""
    q = 1 - percent / 100
    throws = 2 * samples * q
    mean = bits / 2 * (1 - (1 - 2 / bits) ** throws)
    pair = bits * bits / 4 * ((1 - 4 / bits) ** throws - (1 - 2 / bits) ** (2 * throws)) + bits / 4 * (1 - (1 - 4 / bits) ** throws)
    slope = 2 * (1 - 2 / bits) ** throws
    spread = math.sqrt(max(pair, 0) + slope * slope * samples * q * (1 - q))
    return math.ceil(mean + sigmas * spread)


_FEATURES = "doc_id long, text_key long, n_shingles long, fp binary, bands array<long>, sketch array<long>"


def _features(width: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]
    )

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", _words.clear)
        for batch in slices(batches):
            rows: list[list] = [[], [], [], []]
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                m = minhashes(s) if len(s) else None
                rows[0].append(len(s))
                rows[1].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                rows[2].append(band_keys(m) if len(s) else None)
                rows[3].append(odd_sketch(m) if len(s) else None)
            made = (pa.array(r, f.type) for r, f in zip(rows, list(schema)[2:]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *made], schema=schema)

    return apply


def _sets(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary()), ("set", pa.binary())])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", _words.clear)
        for batch in slices(batches):
            sets = [shingle_set(t, width).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return apply


def _near_members(limit: int, percent: int):
    """Members of each bucket, not yet known to be near, that have a sketch near enough to that of another member."""
    schema = pa.schema([("pivot", pa.int64()), ("rep", pa.int64()), ("fp", pa.binary()), ("n_shingles", pa.int64())])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", _words.clear)
        out: list[pa.RecordBatch] = []
        held = 0
        for _, parts in runs(batches, ["bkey", "part_a", "part_b"]):
            t = pa.Table.from_batches(parts)
            sketch = np.concatenate([p.column("sketch").flatten().to_numpy() for p in parts]).view(np.uint64).reshape(-1, SKETCH_WORDS)
            n = t.column("n_shingles").to_numpy()
            known = t.column("known").to_numpy()
            near = known.copy()

            def close(i: int) -> np.ndarray:
                ok = 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])  # noqa: B023
                ok &= np.bitwise_count(sketch ^ sketch[i]).sum(axis=1) <= limit  # noqa: B023
                ok[i] = False
                return ok

            first = close(0)
            near |= first
            near[0] |= first.any()
            for i in range(1, len(n)):
                if not near[i]:
                    hits = close(i)
                    if hits.any():
                        near |= hits
                        near[i] = True
            fresh = near & ~known
            if fresh.any():
                got = t.select(schema.names).filter(pa.array(fresh)).combine_chunks().to_batches()
                out += got
                held += sum(b.num_rows for b in got)
            if held > 5000:
                yield from pa.Table.from_batches(out, schema=schema).combine_chunks().to_batches()
                out, held = [], 0
        if out:
            yield from pa.Table.from_batches(out, schema=schema).combine_chunks().to_batches()

    return apply


def spanning_links(nodes: list, sets: list[np.ndarray], percent: int, joined: np.ndarray | None = None) -> list[tuple]:
    """A spanning forest of the links among these sets: for each set, counts shared with all others at once.

    Nodes are sortable names of the sets; those marked joined are known to be connected.
    """
    order = sorted(range(len(nodes)), key=lambda i: (nodes[i], len(sets[i])))
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    allh = np.concatenate(sets)
    by = np.argsort(allh, kind="stable")
    allh, owner = allh[by], owner[by]
    new = np.concatenate([[True], allh[1:] != allh[:-1]])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(allh))
    value = np.cumsum(new) - 1  # of each posting
    shared = (ends - starts) > 1
    mine = np.argsort(owner, kind="stable")  # the postings of each set lie together
    value_of = value[mine]
    first = np.concatenate([[0], np.cumsum(sizes)])
    label = np.arange(len(nodes))
    if joined is not None and joined.any():
        label[joined] = np.flatnonzero(joined)[0]
        order = [i for i in order if not joined[i]]
    links = []
    for i in order:
        if (label == label[i]).all():
            break
        v = value_of[first[i] : first[i + 1]]
        v = v[shared[v]]
        if not len(v):
            continue
        lens = ends[v] - starts[v]
        pos = np.repeat(starts[v] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        both = np.bincount(owner[pos], minlength=len(nodes))
        hit = np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (label != label[i]))
        for j in hit:
            if label[j] != label[i]:
                if nodes[i] != nodes[j]:
                    links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                label[label == label[j]] = label[i]
    return links


#: A class of texts with equal shingles: its smallest id and the fingerprint of its shingles.
NODE = pa.struct([("rep", pa.int64()), ("fp", pa.binary())])
_NODE = "struct<rep: bigint, fp: binary>"


def _links(percent: int, links_among=spanning_links):
    schema = pa.schema([("u", NODE), ("v", NODE)])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", _words.clear)
        for _, parts in runs(batches, ["pivot", "part_a", "part_b"]):
            t = pa.Table.from_batches(parts)
            nodes = list(zip(t.column("rep").to_pylist(), t.column("fp").to_pylist()))
            sets = [np.frombuffer(b, np.uint64) for b in t.column("set").to_pylist()]
            found = links_among(nodes, sets, percent, t.column("known").to_numpy())
            if found:
                ends = ([dict(zip(("rep", "fp"), x[k])) for x in found] for k in (1, 0))
                yield pa.RecordBatch.from_arrays([pa.array(e, NODE) for e in ends], schema=schema)

    return apply


def _linked_with_lead(percent: int):
    """Marks the members of large groups whose set is linked with that of the group's lead, which comes first in each part."""
    schema = pa.schema([("pivot", pa.int64()), ("rep", pa.int64()), ("fp", pa.binary()), ("known", pa.bool_())])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", _words.clear)
        lead = np.zeros(0, np.uint64)
        for batch in slices(batches):
            known = []
            for mine, is_lead in zip(batch.column("set"), batch.column("is_lead").to_pylist()):
                s = np.frombuffer(mine.as_py(), np.uint64)
                if is_lead:
                    lead = s
                at = np.searchsorted(lead, s)
                both = int((lead[np.minimum(at, len(lead) - 1)] == s).sum())
                known.append(100 * both >= percent * (len(s) + len(lead) - both))
            members = pa.array([not x for x in batch.column("is_lead").to_pylist()], pa.bool_())
            marked = pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:3]), pa.array(known, pa.bool_())], schema=schema)
            yield marked.filter(members)

    return apply


def _deal(df: DataFrame, key: str, weight: str, block: int) -> DataFrame:
    """Rows of df (key, rep, fp, known, ...) dealt to tasks (part_a, part_b) in which they meet.

    Of each key, rows not known meet each other and the known ones, known ones do not meet
    each other. Weights of the rows of a part come to about block. Rows of a key without
    any row that is not known meet nobody, and go.
    """
    parts = df.groupBy(key).agg(
        F.ceil(F.coalesce(F.sum(F.when(~F.col("known"), F.col(weight))), F.lit(0)) / block).cast("int").alias("__rest"),
        F.ceil(F.coalesce(F.sum(F.when(F.col("known"), F.col(weight))), F.lit(0)) / block).cast("int").alias("__done"),
    )
    held = df.join(parts.filter("__rest > 0"), key).withColumn("__own", F.pmod(F.xxhash64("rep", "fp"), F.when(F.col("known"), F.col("__done")).otherwise(F.col("__rest"))).cast("int"))
    pair = lambda a, b: F.struct(a.cast("int").alias("part_a"), b.cast("int").alias("part_b"))
    own, upto = F.col("__own"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    among = F.transform(upto("__rest"), lambda o: pair(F.least(own, o), F.greatest(own, o)))
    to_known = F.when(F.col("__done") > 0, F.transform(upto("__done"), lambda o: pair(own, -1 - o))).otherwise(F.array().cast("array<struct<part_a:int,part_b:int>>"))
    to_rest = F.transform(upto("__rest"), lambda o: pair(o, -1 - own))
    where = F.when(F.col("known"), to_rest).otherwise(F.concat(among, to_known))
    return held.select(*df.columns, F.inline(where))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v) can reach; nodes are of any type with an order.

    Alternating large-star and small-star steps; every round is written to the shared
    folder. Minima are taken with map-side combining, so a node with very many links is
    no unbounded group; joins on it can be split by adaptive execution. Rounds grow with the
    logarithm of a path's length; should max_rounds not suffice, this fails and returns nothing.
    """
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or tuple(state) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(state)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p"))
        e = materialize(small.select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).filter("u <> v").distinct(), "edges")
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def _near(reps: DataFrame, percent: int) -> DataFrame:
    """(pivot, rep, fp, n_shingles): classes with a near sketch in a bucket whose smallest id is pivot."""
    limit = sketch_limit(percent)
    kept = ["pivot", "rep", "fp", "n_shingles"]
    banded = reps.select(F.explode("bands").alias("bkey"), "rep", "fp")
    shared = materialize(banded.groupBy("bkey").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).filter("size > 1"), "buckets")
    members = lambda condition: banded.join(shared.filter(condition), "bkey").join(reps.select("rep", "fp", "n_shingles", "sketch"), ["rep", "fp"])

    large = members(F.col("size") > BUCKET_BLOCK)  # few buckets, so this does not shuffle all rows once more
    first = large.filter("rep = pivot").groupBy("bkey").agg(F.min(F.struct("fp", "n_shingles", "sketch")).alias("lead"))
    leads = first.select("bkey", F.col("lead.n_shingles").alias("lead_n"), F.col("lead.sketch").alias("lead_sketch"))
    apart = F.aggregate(F.zip_with("sketch", "lead_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    like = (100 * F.least("n_shingles", "lead_n") >= percent * F.greatest("n_shingles", "lead_n")) & (apart <= limit)
    of_large = materialize(large.join(leads, "bkey").withColumn("known", like), "large")  # a lead is like itself

    of_small = members(F.col("size") <= BUCKET_BLOCK).withColumn("known", F.lit(False)).withColumns({"part_a": F.lit(0), "part_b": F.lit(0)})
    columns = ["bkey", "part_a", "part_b", *kept, "known", "sketch"]
    dealt = of_small.select(columns).unionByName(_deal(of_large.withColumn("one", F.lit(1)), "bkey", "one", BUCKET_BLOCK).select(columns))
    found = (
        dealt.repartition("bkey", "part_a", "part_b")
        .sortWithinPartitions("bkey", "part_a", "part_b", "rep")
        .mapInArrow(_near_members(limit, percent), "pivot long, rep long, fp binary, n_shingles long")
    )
    return materialize(found.unionByName(of_large.filter("known").select(kept)).distinct(), "near")


def text_links(docs: DataFrame, near: DataFrame, width: int, percent: int, links_among=spanning_links) -> DataFrame:
    """Links (u, v) of classes that connect whatever is linked among near's classes, counted on full sets.

    Members of a group (pivot, rep, fp, n_shingles) meet in links_among; of large groups, those
    linked with the lead meet only the others. A lead goes once to each part of its group's members.
    """
    texts = reduce_by_ids(docs.filter("doc_id is not null"), "doc_id", near, "rep")
    sets = texts.mapInArrow(_sets(width), "doc_id long, fp binary, set binary").withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "fp"])
    sets = materialize(sets.join(near.select("rep", "fp").distinct(), ["rep", "fp"], "left_semi"), "sets")
    sizes = near.groupBy("pivot").agg(F.sum("n_shingles").alias("size"), F.min(F.struct("rep", "fp")).alias("lead"))

    large = sizes.filter(F.col("size") > GROUP_BLOCK).select("pivot", F.col("lead.rep").alias("rep"), F.col("lead.fp").alias("fp"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / GROUP_BLOCK)).cast("int")
    wide = sizes.filter(F.col("size") > GROUP_BLOCK).select("pivot", "lead", parts.alias("parts"))
    leads = wide.select("pivot", F.col("lead.rep").alias("rep"), F.col("lead.fp").alias("fp"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_lead"))
    members = near.join(wide.select("pivot", "parts"), "pivot").select("pivot", "rep", "fp", F.pmod(F.xxhash64("rep", "fp"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_lead"))
    led = leads.unionByName(members).join(sets, ["rep", "fp"]).repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.desc("is_lead"))
    marked = materialize(led.mapInArrow(_linked_with_lead(percent), "pivot long, rep long, fp binary, known boolean"), "marked")
    with_lead = marked.filter("known").join(large.select("pivot", F.struct("rep", "fp").alias("v")), "pivot").select(F.struct("rep", "fp").alias("u"), "v").filter("u <> v")

    of_small = near.join(sizes.filter(F.col("size") <= GROUP_BLOCK), "pivot").withColumn("known", F.lit(False)).withColumns({"part_a": F.lit(0), "part_b": F.lit(0)})
    columns = ["pivot", "part_a", "part_b", "rep", "fp", "known"]
    of_large = _deal(marked.join(near, ["pivot", "rep", "fp"]), "pivot", "n_shingles", GROUP_BLOCK)
    met = (
        of_small.select(columns)
        .unionByName(of_large.select(columns))
        .join(sets, ["rep", "fp"])
        .repartition("pivot", "part_a", "part_b")
        .sortWithinPartitions("pivot", "part_a", "part_b", "rep", "fp")
        .mapInArrow(_links(percent, links_among), f"u {_NODE}, v {_NODE}")
    )
    return met.unionByName(with_lead.select(F.col("u").cast(_NODE).alias("u"), F.col("v").cast(_NODE).alias("v")))


def classes_of(feats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of features (doc_id, fp, ...): each class with its smallest id and copies, and one row of features for each class."""
    some = feats.filter("fp is not null and doc_id is not null")
    classes = materialize(some.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = some.withColumnRenamed("doc_id", "rep").join(classes.select("fp", "rep"), ["rep", "fp"], "left_semi")
    return classes, materialize(reps.dropDuplicates(["rep", "fp"]).drop("text_key"), "reps")


def reached(feats: DataFrame, classes: DataFrame, links: DataFrame, by_id: bool) -> DataFrame:
    """doc_id, text_key, n_shingles, its class (rep, fp) and the smallest class it reaches (first_rep, first_fp), for each row.

    With by_id, classes with a common id are linked, and a row without shingles has the class of its id, if any.
    """
    many = classes.filter("copies > 1").select("fp", "rep")
    rows = feats.select("doc_id", "text_key", "n_shingles", "fp").join(many, "fp", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    if by_id:
        texts_of = feats.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n"), F.count("fp").alias("with_text"))
        several = texts_of.filter("low <> high or (with_text > 0 and with_text < n)").select("doc_id")
        node = F.struct("rep", "fp")
        nodes = materialize(rows.filter("fp is not null").join(several, "doc_id", "left_semi").select("doc_id", node.alias("v")).distinct(), "ids")
        of_id = nodes.groupBy("doc_id").agg(F.min("v").alias("u"))
        same_id = nodes.join(of_id, "doc_id").filter("u <> v").select(F.col("u").cast(_NODE).alias("u"), F.col("v").cast(_NODE).alias("v"))
        links = links.unionByName(same_id)
        own = of_id.select("doc_id", F.col("u.rep").alias("id_rep"), F.col("u.fp").alias("id_fp"))
        rows = rows.join(own, "doc_id", "left").withColumns({"rep": F.when(F.col("fp").isNull(), F.coalesce("id_rep", "rep")).otherwise(F.col("rep")), "fp": F.coalesce("fp", "id_fp")}).drop("id_rep", "id_fp")
    found = components(links).select(F.col("node.rep").alias("rep"), F.col("node.fp").alias("fp"), F.col("component.rep").alias("first_rep"), F.col("component.fp").alias("first_fp"))
    rows = rows.join(found, ["rep", "fp"], "left")
    return rows.withColumns({"first_rep": F.coalesce("first_rep", "rep"), "first_fp": F.coalesce("first_fp", "fp")})


def _grouped(docs: DataFrame, width: int, percent: int, by_id: bool) -> DataFrame:
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 80 percent or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    feats = materialize(docs.mapInArrow(_features(width), _FEATURES), "features")
    classes, reps = classes_of(feats)
    return reached(feats, classes, text_links(docs, _near(reps, percent), width, percent), by_id)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Rows are linked where 100 * shared >= percent * union of their distinct shingles of
    width words. See the module for cases and for the chance of a miss, which holds
    for a percent of 80 or more.
    """
    rows = _grouped(docs, width, percent, by_id=True)
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("first_rep")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with the first text of each group of linked texts, under the smallest id it has.

    Rows equal in id and text stay or go together.
    """
    rows = _grouped(docs, width, percent, by_id=False).filter("doc_id is not null and fp is not null")
    gone = rows.filter("doc_id <> first_rep or fp <> first_fp").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = (docs["doc_id"].cast("long") == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)
