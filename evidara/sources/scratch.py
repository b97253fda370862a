"""Results that several parts of a plan read again, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode, a fresh folder for this session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evidara-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def kept_place(spark: SparkSession, name: str) -> str:
    """A folder that stays, for what later sessions read again."""
    return f"{shared_root(spark)}/evidara-core/kept/{name}"


def shared_place(spark: SparkSession, name: str) -> str:
    """A fresh folder, which goes when the driver ends."""
    path = f"{shared_root(spark)}/evidara-core/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


#: By thread, the folders of settled results of each scope that is open, the innermost last.
_open = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is settled within goes at the end, so nothing that is made of it may be read later."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Has shuffle files of queries that are done deleted: Spark does so for plans that the driver's JVM has collected,
    which a large heap puts off until after files of many queries lie on the disks."""
    spark._jvm.System.gc()


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read from Parquet from here on."""
    place = shared_place(df.sparkSession, name)
    if getattr(_open, "scopes", None):
        _open.scopes[-1].append(place)
    path = f"{place}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
