"""Token files with constant-time access by document key.

A shard holds documents of a range of keys in ascending order: a file of raw ids, and
an index over it. The index is a minimal perfect hash of the keys (a displacement for
each small bucket of keys, made so that no two keys share a slot) with a fingerprint
of the key in each slot, so one probe finds a key's record and an absent key is told
apart but for one in 2^32. Files are written under a name of the task attempt and then
renamed, so a task that runs again or twice leaves the same files.

shard-N.ids: 16 bytes (b"EVIDS1", width of an id in bytes as one byte, a zero byte,
number of ids as 8 bytes), then ids, little-endian.
shard-N.idx: b"EVIDX1\\0\\0", four 8-byte counts (records, distinct keys, buckets, rows
without key), then record starts (8 bytes each, one more than records), displacements
(4 bytes each), and by slot: fingerprints (4), first records (4), counts of records (4).

Defined cases: a null or empty text is the end id alone; rows with equal keys are kept
one after another, in order of their texts' beginnings, and the index gives the first and
their number; so many that they fill a shard go on in the next, and are read from both; rows with a null key
come first and have no entry, but are kept and read back; an empty table gives no files.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import encode_each, parted
from .common import gone_at_exit, hold, scratch_path, slices

_IDS, _IDX = b"EVIDS1", b"EVIDX1\0\0"


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shifted(h1: np.ndarray, h2: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    x = h1 + shift * h2
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: slots are 0 to len(keys) - 1."""

    def __init__(self, n: int, shifts: np.ndarray):
        self.n, self.shifts = n, shifts

    @staticmethod
    def buckets_of(n: int) -> int:
        return n // 4 + 1

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        shifts = np.zeros(cls.buckets_of(n), np.int32)
        if not n:
            return cls(0, shifts)
        bucket = (_mixed(keys, 1) % np.uint64(len(shifts))).astype(np.int64)
        h1, h2 = _mixed(keys, 2), _mixed(keys, 3) | np.uint64(1)
        by = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(shifts))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.zeros(n, bool)
        tries = np.arange(64, dtype=np.uint64)
        alone = []
        for b in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[b])
            if size == 0:
                break
            own = by[starts[b] : starts[b] + size]
            if size == 1:
                alone.append((b, int(own[0])))
                continue
            at = 0
            while True:  # 64 displacements at a time
                slots = _shifted(h1[own][None, :], h2[own][None, :], (tries + np.uint64(at))[:, None], n)
                free = ~taken[slots].any(axis=1)
                if size > 1:
                    ordered = np.sort(slots, axis=1)
                    free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if free.any():
                    k = int(np.argmax(free))
                    taken[slots[k]] = True
                    shifts[b] = at + k
                    break
                at += 64
                if at > 1 << 24:
                    raise ValueError("keys are not distinct")
        left = np.flatnonzero(~taken)
        for (b, _), slot in zip(alone, left.tolist()):
            shifts[b] = -1 - slot  # a single key names its slot
        return cls(n, shifts)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; keys that were not built in get any slot."""
        if not self.n:
            return np.zeros(len(keys), np.int64)
        shift = self.shifts[(_mixed(keys, 1) % np.uint64(len(self.shifts))).astype(np.int64)].astype(np.int64)
        moved = _shifted(_mixed(keys, 2), _mixed(keys, 3) | np.uint64(1), np.maximum(shift, 0).astype(np.uint64), self.n)
        return np.where(shift < 0, -1 - shift, moved)

    @staticmethod
    def fingerprints(keys: np.ndarray) -> np.ndarray:
        return (_mixed(keys, 4) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: np.ndarray, starts: np.ndarray, without_key: int) -> bytes:
    """The index of records in ascending order of keys; starts has one more entry than there are records."""
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    marks, firsts, counts = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    marks[slot], firsts[slot], counts[slot] = mph.fingerprints(distinct), first + without_key, count
    head = _IDX + struct.pack("<4Q", len(starts) - 1, len(distinct), len(mph.shifts), without_key)
    return head + b"".join([starts.astype("<u8").tobytes(), mph.shifts.astype("<i4").tobytes(), marks.tobytes(), firsts.tobytes(), counts.tobytes()])


def _place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)


class Shard:
    """One shard, opened for reading by key."""

    def __init__(self, folder: str, number: int):
        fs, path = _place(folder)
        with fs.open_input_file(f"{path}/shard-{number:06d}.idx") as f:
            raw = f.read()
        if raw[:8] != _IDX:
            raise ValueError("not an index of token files")
        records, keys, buckets, self.without_key = struct.unpack_from("<4Q", raw, 8)
        at = 40
        parts = []
        for count, kind in ((records + 1, "<u8"), (buckets, "<i4"), (keys, "<u4"), (keys, "<u4"), (keys, "<u4")):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        self.starts, shifts, self.marks, self.firsts, self.counts = parts
        self.mph = PerfectHash(keys, shifts)
        self.file = fs.open_input_file(f"{path}/shard-{number:06d}.ids")
        head = self.file.read_at(16, 0)
        if head[:6] != _IDS:
            raise ValueError("not a file of token ids")
        self.width = head[6]
        self.loaded: np.ndarray | None = None

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; number 0 where the key is absent."""
        if not self.mph.n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.mph.slots(keys)
        here = self.marks[slot] == self.mph.fingerprints(keys)
        return self.firsts[slot].astype(np.int64), np.where(here, self.counts[slot], 0).astype(np.int64)

    def load(self) -> None:
        """Reads all ids at once, for callers that want most records."""
        count = int(self.starts[-1])
        self.loaded = np.frombuffer(self.file.read_at(count * self.width, 16), f"<u{self.width}")

    def ids(self, record: int) -> np.ndarray:
        a, b = int(self.starts[record]), int(self.starts[record + 1])
        if self.loaded is not None:
            return self.loaded[a:b].astype("<u4")
        return np.frombuffer(self.file.read_at((b - a) * self.width, 16 + a * self.width), f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of the documents of this key."""
        first, count = (int(x[0]) for x in self.find(np.array([key], np.int64)))
        return [self.ids(first + k) for k in range(count)]

    def close(self) -> None:
        self.file.close()


def _alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies; newline stays, to part words."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others) if b != 10}


_ALPHABET = _alphabet()


class _Encoder:
    """Ids of whole texts by the tokenizers library; of chunks where it splits before every space and newline."""

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        said = json.loads(spec)
        pre = said.get("pre_tokenizer") or {}
        self.by_chunk = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and said.get("normalizer") is None and said.get("post_processor") is None and said["model"]["type"] == "BPE"
        self.special = [x["content"] for x in said.get("added_tokens", [])]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = [len(x) for x in vocabulary]
        #: The same merges over text that is mapped to the alphabet of bytes and parted by white space.
        self.merges = Tokenizer.from_str(json.dumps(said | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "decoder": None, "added_tokens": []})) if self.by_chunk else None

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _encode_words(self, spaced: list[str], bare: list[str]) -> list[bytes]:
        """Ids of words of letters, the first with a space before each: mapped to the alphabet of
        bytes here, they go to the library's merges in one call, with white space between."""
        if not spaced and not bare:
            return []
        mapped = "\n".join([" " + "\n ".join(spaced)] * bool(spaced) + bare)
        if not mapped.isascii():
            mapped = mapped.encode("utf-8", "surrogatepass").decode("latin-1").translate(_ALPHABET)
        mapped = mapped.replace(" ", _ALPHABET[32])
        ids = np.array(self.merges.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, self.kind)
        # Tokens of a word have its characters together, which tells where words end without the library's offsets.
        tokens, parts = np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, mapped.split("\n")), np.int64))
        last = np.minimum(np.searchsorted(tokens, parts), max(0, len(tokens) - 1))
        if not len(tokens) or not np.array_equal(tokens[last], parts) or tokens[-1] != parts[-1]:
            return [self._encode(f" {w}") for w in spaced] + [self._encode(w) for w in bare]
        raw, ends = ids.tobytes(), ((last + 1) * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def encode_joined(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each with the end id after it if there is one; and their numbers.

        Chunks are objects once for all texts: these are parted, told apart and put together again as arrays.
        """
        marked = [parted(t) if t and self.by_chunk and not any(x in t for x in self.special) else None for t in texts]
        whole = [(i, self._encode(t)) for i, (t, m) in enumerate(zip(texts, marked)) if t and m is None]
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        numbered = lists.flatten().dictionary_encode()
        pieces = encode_each(numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known, self._encode_words, self._encode)
        # Texts that were encoded whole, and the end id, are one piece more each.
        chunks, stops, n = numbered.indices.to_numpy(), lists.offsets.to_numpy()[1:], len(pieces)
        pieces += [x for _, x in whole]
        at, of = stops[[i for i, _ in whole]], np.arange(n, len(pieces))
        if whole:
            stops = stops + np.searchsorted([i for i, _ in whole], np.arange(len(texts)), side="right")
            chunks = np.insert(chunks, at, of)
        if end is not None:
            chunks = np.insert(chunks, stops, len(pieces))
            stops = stops + np.arange(1, len(texts) + 1)
            pieces.append(np.array([end], self.kind).tobytes())
        ids = np.frombuffer(b"".join(pieces), self.kind)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // ids.itemsize
        starts = np.cumsum(lengths) - lengths
        sizes = lengths[chunks]
        ends = np.cumsum(sizes)
        places = np.repeat(starts[chunks] - (ends - sizes), sizes)
        places += np.arange(len(places))
        bounds = np.append(0, ends)[stops]
        return ids[places], np.diff(bounds, prepend=0)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        ids, sizes = self.encode_joined(texts)
        raw, ends = ids.tobytes(), (np.cumsum(sizes) * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


_encoders: dict[str, _Encoder] = {}


def _encoder(spec: str) -> _Encoder:
    hold("token_store", _encoders.clear)
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = _Encoder(spec)
    return _encoders[key]


#: Bytes of text of a shard on the mean, at most.
BYTES_PER_SHARD = 64 << 20
#: Rows, and bytes of their texts, that are encoded at a time; a longer text is encoded alone.
ROWS, BYTES = 2048, 4 << 20
_MANIFEST = "shard long, documents long, ids long, without_key long, low long, high long"


def _small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to ROWS rows, and to BYTES bytes of text where these are more than one row."""
    for batch in slices(batches, ROWS):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, before + BYTES, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def _writer(spec, folder: str, end_id: int):
    names = [x.split()[0] for x in _MANIFEST.split(", ")]

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = _encoder(spec.value), TaskContext.get()
        number, attempt = context.partitionId(), context.taskAttemptId()
        fs, path = _place(folder)
        width = np.dtype(encoder.kind).itemsize
        file, keys, sizes, without = None, [], [], 0
        name = f"{path}/shard-{number:06d}"
        gc.disable()  # what is made here has no cycles, and the kept chunks are many
        try:
            for batch in _small(batches):
                if file is None:
                    fs.create_dir(path)
                    file = fs.open_output_stream(f"{name}.ids.{attempt}")
                    file.write(_IDS + bytes([width, 0]) + b"\0" * 8)
                without += batch.column("doc_id").null_count
                keys.append(batch.column("doc_id").drop_null().to_numpy())
                ids, counts = encoder.encode_joined(batch.column("text").to_pylist(), end_id)
                file.write(ids.tobytes())
                sizes.append(counts)
        finally:
            gc.enable()
        if file is None:
            return
        file.close()
        keys = np.concatenate(keys)
        starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        with fs.open_output_stream(f"{name}.idx.{attempt}") as index:
            index.write(index_bytes(keys, starts, without))
        for end_of_name in ("ids", "idx"):
            fs.move(f"{name}.{end_of_name}.{attempt}", f"{name}.{end_of_name}")
        row = (number, len(starts) - 1, int(starts[-1]), without, *((int(keys[0]), int(keys[-1])) if len(keys) else (None, None)))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=names)

    return apply


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str | None = None, end_id: int = 2, docs_per_shard: int = 10_000) -> tuple[str, DataFrame]:
    """Ids of all texts of docs (doc_id, text) in token files; (their folder, one manifest row per shard).

    folder is reached by driver and executors alike, through pyarrow's file systems; without
    one, a new folder in spark.checkpoint.dir, which goes when the driver ends. Shards are ranges
    of doc_id, of about docs_per_shard documents or fewer, so that their texts come to about
    BYTES_PER_SHARD on the mean, and follow one another in ascending order. Rows of one id, full
    repeats too, may lie in several shards, so a frequent id is no large task.
    """
    spark = docs.sparkSession
    own = False
    if folder is None:
        folder, own = scratch_path(spark, "tokens"), True
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(1, -(-size["n"] // docs_per_shard), -(-(size["bytes"] or 0) // BYTES_PER_SHARD))
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 16).asc_nulls_first(), F.xxhash64("text")]
    placed = docs.withColumn("place", F.monotonically_increasing_id())  # parts full repeats, whose order changes nothing
    dealt = placed.repartitionByRange(shards, *order, "place").sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_writer(spec, folder, end_id), _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    fs, path = _place(folder)
    for info in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):  # a few names for each shard
        if info.base_name.split(".")[-1].isdigit():
            fs.delete_file(info.path)  # of an attempt that failed
    if own:
        gone_at_exit(spark, folder)
    return folder, spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(folder: str, manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record of these keys, found through the indexes.

    keys has each key once or more; null stands for all rows without key. Absent keys give no
    row. The manifest, one row per shard, goes through the driver.
    """
    spark = keys.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: r["shard"])
    firsts, total = {}, 0
    for r in rows:
        firsts[r["shard"]] = total
        total += r["ids"]
    keyed = [r for r in rows if r["low"] is not None]
    lows, highs = (np.array([r[c] for r in keyed], np.int64) for c in ("low", "high"))
    numbers = [r["shard"] for r in keyed]
    without = [r["shard"] for r in rows if r["without_key"]]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    @F.pandas_udf("long")
    def first_place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(highs, k.to_numpy(np.int64), side="left"))

    @F.pandas_udf("long")
    def last_place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(lows, k.to_numpy(np.int64), side="right") - 1)

    def read(group: pa.Table) -> pa.Table:
        place = group.column("place")[0].as_py()
        number = numbers[place] if place >= 0 else -1 - place
        shard = Shard(folder, number)
        try:
            out: list[tuple] = []
            wanted = group.column("key")
            if wanted.null_count:
                out += [(None, r) for r in range(shard.without_key)]
            present = np.unique(wanted.drop_null().to_numpy())
            first, count = shard.find(present)
            if 2 * len(present) > len(shard.starts):
                shard.load()
            out += [(int(k), int(f) + i) for k, f, c in zip(present, first, count) for i in range(c)]
            got = []
            for k, record in out:
                ids = shard.ids(record)
                got.append((k, firsts[number] + int(shard.starts[record]), len(ids), zlib.crc32(ids.tobytes())))
        finally:
            shard.close()
        return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*got)] if got else [pa.array([], pa.int64())] * 4, schema=schema)

    k = keys.select(F.col(key).cast("long").alias("key"))
    some = k.filter("key is not null").distinct().withColumns({"low": first_place("key"), "high": last_place("key")}).filter("low <= high")
    some = some.select("key", F.explode(F.sequence("low", "high")).alias("place"))  # one place, but for keys that fill a shard
    none = k.filter("key is null").limit(1).select("key", F.explode(F.array(*(F.lit(-1 - n) for n in without)).cast("array<long>")).alias("place"))
    return some.unionByName(none).groupBy("place").applyInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
