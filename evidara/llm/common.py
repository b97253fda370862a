"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: space, tab, LF, VT, FF, CR. bytes.split() parts at the same ones.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Rows of a batch that are turned into Python objects at a time.
SLICE = 256


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a fresh one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="evidara-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/evidara/{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Marks a folder of intermediate rows to be deleted when the driver ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage is cut, lost executors cost nothing.

    The folder goes when the driver ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null ids fall in fold 1, which is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % folds, F.lit(1))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut to few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Says that a task's process keeps memory for an operator, and lets go of that of others: Spark
    uses its Python processes again, and stages of one job would else add up there."""
    others = [o for o in _held if o != owner]
    for other in others:
        _held.pop(other)()
    if others:  # what they let go of goes back to the system too
        gc.collect()
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()
    _held[owner] = clear


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows with equal keys, of batches that are sorted by keys: (key values, parts of batches).

    A run is held whole, so callers bound its rows by the keys they choose.
    """
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a].item() for c in columns)
            if key != last:
                if held:
                    yield last, held
                last, held = key, []
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def reduce_by_ids(df: DataFrame, key: str, ids: DataFrame, id_column: str, bits: int = 1 << 22) -> DataFrame:
    """Rows of df whose key may be among ids: a bitmap of hashed ids goes to every task.

    The bitmap has bits / 64 rows at most, whatever the number of ids, so it can be
    broadcast. Rows that it lets through wrongly fall in the join that follows.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = (
        ids.select(slot(F.col(id_column)).alias("__slot"))
        .groupBy(F.shiftright("__slot", 6).alias("__word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(__slot & 63 as int))")).alias("__bits"))
    )
    held = df.withColumn("__key_slot", slot(F.col(key)))
    joined = held.join(F.broadcast(words), F.shiftright("__key_slot", 6) == F.col("__word"))
    hit = F.expr("(shiftright(__bits, cast(__key_slot & 63 as int)) & 1) = 1")
    return joined.filter(hit).drop("__word", "__bits", "__key_slot")
