"""Reading tables, scratch tables in the shared folder, and word splitting used by several operators."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, MutableMapping
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators.lookup import split_join
from loanloom.sources import shared_dir


_shipped: set[str] = set()
# Bytes of one batch sent to a Python worker, where the session names none: ten thousand long texts would not fit.
ARROW_BYTES = 4 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to Python workers, which need not find it on a path of their own, in bounded batches."""
    if spark.conf.get(_ARROW_BYTES, None) is None:
        spark.conf.set(_ARROW_BYTES, str(ARROW_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    made = tempfile.mkdtemp(prefix="loanloom-")  # read by the driver alone, which serves it to executors
    context.addPyFile(shutil.make_archive(os.path.join(made, "loanloom"), "zip", root, "loanloom"))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str = "stash") -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage without computing it twice.

    The files stay in the scratch folder the cluster names, since whoever got
    the frame may read it at any later time.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_Batch = TypeVar("_Batch")


def released(batches: Iterator[_Batch], *caches: MutableMapping) -> Iterator[_Batch]:
    """The same results; after a task's last one, its worker gives back the memory that no later task needs."""
    try:
        yield from batches
    finally:
        for cache in caches:
            cache.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)


# Ids that are sent to every task; as a hash table they take some tens of megabytes.
BROADCAST_IDS = 1_000_000


def checked_broadcast(ids: DataFrame) -> DataFrame:
    """A stored column of ids, marked for broadcast only if a count shows it to be short; else joins shuffle it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def looked_up(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a stored table of one row per key: broadcast if a count shows it to be short, else split at hot keys."""
    if stored.count() <= BROADCAST_IDS:
        return df.join(F.broadcast(stored), keys, "left")
    return split_join(df, stored, keys)
