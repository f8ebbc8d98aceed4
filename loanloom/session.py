"""Session settings the operators are written for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import RLock
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

_Result = TypeVar("_Result")
# Spark's own switch: the shuffle files of a query are deleted when it ends, not when the driver happens to collect garbage.
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_switching = RLock()


def build_session(app_name: str = "loanloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots.

    Adaptive execution coalesces small shuffle partitions and splits skewed
    join partitions, so on a cluster ``spark.sql.shuffle.partitions`` should be
    set high (a few per core) and left for Spark to shrink.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), str(value))
    return builder.getOrCreate()


def together(spark: SparkSession, *calls: Callable[[], _Result]) -> list[_Result]:
    """Results of calls that run jobs independent of one another, so that one's tail does not leave the cluster idle."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]
        return [s.result() for s in started]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind, so the disk holds those of the running ones alone.

    A frame made inside keeps the habit: an action that repeats one on the very same frame shuffles anew.
    """
    with _switching:
        before = spark.conf.get(_FILE_CLEANUP, None)
        spark.conf.set(_FILE_CLEANUP, "true")
        try:
            yield
        finally:
            if before is None:
                spark.conf.unset(_FILE_CLEANUP)
            else:
                spark.conf.set(_FILE_CLEANUP, before)
