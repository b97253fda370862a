"""A kept trigram index: postings written once, by buckets of grams, and maintained by deltas.

An index is a folder of segments. Each has postings (gram, n, and the rows, as places in a block of keys), in
folders by a bucket of the gram, the keys of the blocks in one folder more, and rows (key, lengths of the
fields, dropped). A compacted segment has keys in its postings and no blocks. A later segment takes the place of
earlier ones for the keys that it has, so an update costs what it changes, and a search
reads the buckets of its grams only. compact() makes one segment of all.

A phrase is a substring without regard to case, so a row with the phrase has all its trigrams
in one field; candidates() gives the rows that have them in any, to be verified by containment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.slices import cut
from ..sources.scratch import kept_place

BUCKETS = 64
#: Trigrams of a phrase that narrow a scan; rows that have these only by chance are told apart by containment.
RAREST = 4
#: Rows, and characters of them, whose grams are gathered before they go out together: a block, whose keys go out once.
GATHERED, CHARACTERS = 1 << 14, 1 << 20
POSTING = "bucket int, gram long, n int, block long, places array<short>, keys array<{}>"


def gram_codes(text: str) -> np.ndarray:
    """Each distinct run of three characters as one number."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)


def bucket_of(grams: np.ndarray) -> np.ndarray:
    return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 6)).astype(np.int32)


def gram_rows(fields: Sequence[Sequence[str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Each gram of rows (texts of one field after another) with each row that has it in a field, by gram and row."""
    n = len(fields[0])
    texts = [t or "" for field in fields for t in field]
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = [len(t) for t in texts]
    part = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    met = np.zeros(0x110000, bool)
    met[c] = True
    letters = np.flatnonzero(met)
    bits, low = max(1, len(letters) - 1).bit_length(), max(1, n - 1).bit_length()
    kind = np.uint32 if 3 * bits + low <= 32 else np.int64
    number = np.zeros(0x110000, kind)
    number[letters] = np.arange(len(letters))
    c = number[c]
    inside = part[2:] == part[:-2]
    grams = ((c[:-2] << 2 * bits) | (c[1:-1] << bits) | c[2:])[inside]
    rows = np.repeat(np.tile(np.arange(n, dtype=kind), len(fields)), sizes)[2:][inside]
    if 3 * bits + low <= 63:  # gram and row fit in one number
        both = np.sort((grams << low) | rows)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])].astype(np.int64) if len(both) else both.astype(np.int64)
        grams, rows = both >> low, both & ((1 << low) - 1)
    else:
        order = np.lexsort((rows, grams))
        grams, rows = grams[order], rows[order]
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])])[: len(grams)]
        grams, rows = grams[new], rows[new]
    mask = (1 << bits) - 1
    return (letters[grams >> 2 * bits] << 42) | (letters[grams >> bits & mask] << 21) | letters[grams & mask], rows


def _postings(fields: Sequence[str]):
    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, [whole.column(f) for f in fields], GATHERED, CHARACTERS):
                g, o = gram_rows([batch.column(f).to_pylist() for f in fields])
                if not len(g):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                sizes = np.diff(np.append(starts, len(g)))
                names = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("key"))
                digest = hashlib.sha256("\n".join(map(str, batch.column("key").to_pylist())).encode("utf-8", "surrogatepass")).digest()
                block = int.from_bytes(digest[:8], "big", signed=True)
                m = len(starts)
                postings = {
                    "bucket": pa.array(bucket_of(g[starts])), "gram": pa.array(g[starts]), "n": pa.array(sizes, pa.int32()), "block": pa.array(np.full(m, block)),
                    "places": pa.ListArray.from_arrays(pa.array(np.append(starts, len(g)), pa.int32()), pa.array(o.astype(np.int16))), "keys": pa.nulls(m, names.type),
                }
                yield pa.RecordBatch.from_pydict(postings)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([BUCKETS], pa.int32()), "gram": pa.array([0], pa.int64()), "n": pa.array([0], pa.int32()), "block": pa.array([block], pa.int64()),
                    "places": pa.nulls(1, postings["places"].type), "keys": names,
                })

    return apply


class LexicalIndex:
    """The index of rows (key, and texts in fields) under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, key: str, fields: Sequence[str], pinned: Sequence[int] | None = None):
        """pinned names the segments that are read, whatever the folder has: those of one version of a store."""
        self.spark, self.root, self.key, self.fields, self.pinned = spark, root.rstrip("/"), key, list(fields), pinned

    def segments(self) -> list[int]:
        """Numbers of the whole segments; one is named once all of it is written."""
        if self.pinned is not None:
            return sorted(self.pinned)
        try:
            rows = self.spark.read.schema("segment long, first long").parquet(f"{self.root}/_segments").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        first = max((r["first"] for r in rows), default=0)
        return sorted(r["segment"] for r in rows if r["segment"] >= first)

    def _named(self, segment: int, first: int) -> None:
        self.spark.createDataFrame([(segment, first)], "segment long, first long").coalesce(1).write.mode("append").parquet(f"{self.root}/_segments")

    def _write(self, rows: DataFrame, dropped: DataFrame | None, first: int | None = None) -> int:
        n = self.segment(max(self.segments(), default=0) + 1, rows, dropped)
        self._named(n, n if first is None else first)
        return n

    def segment(self, n: int, rows: DataFrame, dropped: DataFrame | None = None, dealt: bool = True) -> int:
        """Writes a segment, which is part of the index once it is named. Where rows fill their tasks, postings need
        not be dealt to others: each task then writes a file for each bucket."""
        place = f"{self.root}/segment-{n}"
        lengths = [F.coalesce(F.length(f), F.lit(0)).cast("long").alias(f"len_{f}") for f in self.fields]
        known = rows.select(F.col(self.key).alias("key"), *lengths, F.lit(False).alias("dropped"))
        if dropped is not None:
            none = [F.lit(0).cast("long").alias(f"len_{f}") for f in self.fields]
            known = known.unionByName(dropped.select(F.col(self.key).alias("key"), *none, F.lit(True).alias("dropped")))
        known.write.mode("overwrite").option("compression", "zstd").parquet(f"{place}/rows")
        kind = dict(rows.dtypes)[self.key]
        low = rows.select(F.col(self.key).alias("key"), *(F.lower(f).alias(f) for f in self.fields))
        self._written(low.mapInArrow(_postings(self.fields), POSTING.format(kind)), place, dealt)
        return n

    def _written(self, postings: DataFrame, place: str, dealt: bool = True) -> None:
        (self._dealt(postings) if dealt else postings).sortWithinPartitions("bucket", "gram").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{place}/postings")

    def build(self, rows: DataFrame) -> None:
        """An index of rows, whatever was there before."""
        self._write(rows, None)

    def update(self, rows: DataFrame, dropped: DataFrame | None = None) -> None:
        """Rows put in or changed, and keys dropped: one segment more."""
        self._write(rows, dropped, min(self.segments(), default=1))

    def compact(self) -> None:
        """All live rows and their postings as one segment."""
        live = self.live()
        n = max(self.segments()) + 1
        place = f"{self.root}/segment-{n}"
        live.drop("segment").withColumn("dropped", F.lit(False)).write.mode("overwrite").option("compression", "zstd").parquet(f"{place}/rows")
        p = self._keyed(self._read_postings().filter(F.col("bucket") < BUCKETS)).join(live.select("key", "segment"), ["key", "segment"], "left_semi")
        lists = p.groupBy("bucket", "gram", F.pmod(F.xxhash64("key"), F.lit(64)).alias("part")).agg(F.count("*").cast("int").alias("n"), F.collect_list("key").alias("keys")).drop("part")
        none = {"block": F.lit(None).cast("long"), "places": F.lit(None).cast("array<short>")}
        self._written(lists.withColumns(none).select("bucket", "gram", "n", "block", "places", "keys"), place)
        self._named(n, n)

    def _dealt(self, postings: DataFrame) -> DataFrame:
        """A frequent gram may fill its bucket, so a bucket is dealt to several tasks, more of them in a larger session."""
        parts = max(4, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        return postings.repartition("bucket", F.pmod(F.xxhash64("block", "keys"), F.lit(parts)))

    def _each(self, table: str, schema: str | None = None) -> DataFrame:
        out = None
        for n in self.segments():
            df = (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.root}/segment-{n}/{table}").withColumn("segment", F.lit(n).cast("long"))
            out = df if out is None else out.unionByName(df)
        return out

    def _read_postings(self) -> DataFrame:
        kind = dict(self._each("rows").dtypes)["key"]
        return self._each("postings", POSTING.format(kind))

    def _keyed(self, postings: DataFrame) -> DataFrame:
        """segment, bucket, gram and key of each row of postings."""
        own = postings.select("segment", "bucket", "gram", F.explode("keys").alias("key"))
        places = postings.select("segment", "bucket", "gram", "block", F.explode(F.col("places").cast("array<int>")).alias("place"))
        names = self._read_postings().filter(F.col("bucket") == BUCKETS).select("segment", "block", F.posexplode("keys").alias("place", "key"))
        return own.unionByName(places.join(names, ["segment", "block", "place"]).select("segment", "bucket", "gram", "key"))

    def live(self) -> DataFrame:
        """key, len_ of each field and segment of every row that is indexed."""
        rows = self._each("rows")
        if len(self.segments()) > 1:
            last = rows.groupBy("key").agg(F.max("segment").alias("segment"))
            rows = rows.join(last, ["key", "segment"])
        return rows.filter("not dropped").drop("dropped")

    def candidates(self, phrase: str) -> DataFrame:
        """Keys of the rows that have every trigram of a phrase of three characters or more."""
        grams = gram_codes(phrase.lower())
        if not len(grams):
            raise ValueError("a phrase of fewer than three characters has no trigram")
        return self._having(grams)

    def _having(self, grams: np.ndarray) -> DataFrame:
        p = self._of(grams)
        have = self._keyed(p).groupBy("segment", "key").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
        if len(self.segments()) > 1:
            have = have.join(self.live().select("key", "segment"), ["key", "segment"], "left_semi")
        return have.select(F.col("key").alias(self.key))


    def _of(self, grams: np.ndarray) -> DataFrame:
        buckets = sorted({int(b) for b in bucket_of(grams)})
        return self._read_postings().filter(F.col("bucket").isin(buckets) & F.col("gram").isin([int(g) for g in grams]))

    def frequencies(self, phrases: Sequence[str]) -> dict[int, int]:
        """Postings of each trigram of the phrases, none where there are none; lists of keys are not read for it."""
        grams = np.unique(np.concatenate([gram_codes(p.lower()) for p in phrases]))
        found = {r["gram"]: r["n"] for r in self._of(grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # one row for each gram asked for
        return {int(g): found.get(int(g), 0) for g in grams}

    def narrowed(self, df: DataFrame, phrases: Sequence[str], share: float = 0.25) -> DataFrame:
        """df without rows that have none of the phrases, as far as the rarest trigrams tell and where it pays: all
        of df if a phrase is too short for it, or if the phrases may stand in more than a share of the rows."""
        asked = list(dict.fromkeys(p.lower() for p in phrases))
        if not asked or any(len(p) < 3 for p in asked):
            return df
        n = self.frequencies(asked)
        rarest = [sorted(gram_codes(p), key=lambda g: n[int(g)])[:RAREST] for p in asked]
        if sum(n[int(gs[0])] for gs in rarest) > share * self.live().count():
            return df
        parts = [self._having(np.array(gs)) for gs in rarest]
        found = reduce(lambda a, b: a.unionByName(b), parts).distinct() if len(parts) > 1 else parts[0]
        return df.join(found, self.key, "left_semi")


def kept_index(name: str, rows: DataFrame, key: str, fields: Sequence[str]) -> LexicalIndex:
    """The index of a table in the shared folder: the kept one, if the table's files are those that it was made of, else a new one."""
    spark = rows.sparkSession
    digest = hashlib.sha256("\n".join([key, *fields, *sorted(file_states(rows))]).encode()).hexdigest()[:16]
    index = LexicalIndex(spark, kept_place(spark, f"index3-{name}-{digest}"), key, fields)
    if not index.segments():
        index.build(rows)
    return index


def file_states(df: DataFrame) -> list[str]:
    """Name, size and time of each file of a table: names and numbers only, so one row per file."""
    spark = df.sparkSession
    out = []
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        s = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append(f"{file} {s.getLen()} {s.getModificationTime()}")
    return out
