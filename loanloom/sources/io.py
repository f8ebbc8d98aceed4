"""Scans, write-once intermediates, shape and preview."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# What stands for a missing field.
NULL_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    null_values: Sequence[str] = NULL_VALUES,
    infer: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """CSV with a header; the ``null_values`` arrive as NULL in every column.

    A declared schema avoids the extra full scan that ``infer`` costs. A field that is
    neither missing nor of its column's type stops the scan, unless ``mode`` is
    ``PERMISSIVE`` (it arrives as NULL) or ``DROPMALFORMED``.
    """
    if (schema is None) != infer:
        raise ValueError("name a schema, or infer one")
    text = spark.read.option("header", True).option("mode", mode).csv(path)
    cleaned = text.select(*[_without(c, null_values) for c in text.columns])
    if infer:
        kinds = _guessed(cleaned)
    else:
        declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        kinds = {f.name: f.dataType.simpleString() for f in declared}
    if set(text.columns) != set(kinds):
        raise ValueError(f"columns differ from the schema: {sorted(set(text.columns) ^ set(kinds))}")
    read = []
    for c, kind in kinds.items():
        value = F.col(f"`{c}`").try_cast(kind)
        bad = F.col(f"`{c}`").isNotNull() & value.isNull()
        if mode == "FAILFAST":
            value = F.when(bad, F.raise_error(F.concat(F.lit(f"{c} is no {kind}: "), F.col(f"`{c}`"))).cast(kind)).otherwise(value)
        elif mode == "DROPMALFORMED":
            cleaned = cleaned.where(~bad)
        read.append(value.alias(c))
    return cleaned.select(*read)


def _without(column: str, null_values: Sequence[str]) -> Column:
    quoted = F.col(f"`{column}`")
    return F.when(~quoted.isin(list(null_values)), quoted).alias(column)


_GUESSES = ("int", "bigint", "double", "date", "timestamp", "boolean")


def _guessed(df: DataFrame) -> dict[str, str]:
    """The first type every field of a column has, in one scan; text if there is none."""
    failed = df.agg(
        *[
            F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(k).isNull()).alias(f"{k}_{i}")
            for i, c in enumerate(df.columns) for k in _GUESSES
        ],
        *[F.count(f"`{c}`").alias(f"known_{i}") for i, c in enumerate(df.columns)],
    ).first()
    return {
        c: next((k for k in _GUESSES if failed[f"known_{i}"] and not failed[f"{k}_{i}"]), "string")
        for i, c in enumerate(df.columns)
    }


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a local one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loanloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder ran to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark))


def fingerprint(df: DataFrame, settings: str = "") -> str:
    """Tells tables apart by columns, source files with their sizes and times, and the caller's settings.

    A frame that reads no files is told by its plan.
    """
    spark = df.sparkSession
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs
    parts = [df.schema.json(), settings]
    for name in sorted(df.inputFiles()):
        path = paths.Path(name)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        parts.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    if len(parts) == 2:
        parts.append(str(df.semanticHash()))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def cache_or_load(df: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """Write Parquet unless a complete write is there (or always with ``refresh``), then read it back.

    A folder without the success mark is a write that broke off, and is written anew.
    """
    if refresh or not is_complete(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed_or_load(
    df: DataFrame, path: str, key: str, buckets: int | None = None, refresh: bool = False
) -> DataFrame:
    """S3/S4 for tables that are joined by a key: written once in buckets of it, so that no join shuffles them again.

    Tables with the same number of buckets (default: the session's shuffle partitions) join each other, and whatever is
    partitioned alike, in place. A frame that is partitioned by the key already, into as many parts, is written
    without a shuffle, one sorted file a bucket. The table's name is found from its path and its layout, so another session
    registers the same files again.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{path}-{buckets}"
    name = f"loanloom_{hashlib.sha256(path.encode()).hexdigest()[:20]}"
    if refresh or not is_complete(spark, path):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        # Stored tables stay on disk beside the shuffles of the next; this codec takes less room than the default one.
        written = df.write.format("parquet").option("compression", "zstd").mode("overwrite").option("path", path)
        written.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    elif not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} ({df.schema.toDDL()}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
            f"INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def shape(df: DataFrame, name: str | None = None) -> DataFrame:
    """One row with the number of rows and columns."""
    result = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long")
    )
    return result if name is None else result.select(F.lit(name).alias("table"), "*")


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First n rows, by an explicit order when one is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def tail(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """Last n rows of an explicit order, as a top-n of the reverse order."""
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n)
