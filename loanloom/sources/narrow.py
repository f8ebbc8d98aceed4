"""Narrower storage types chosen from the observed range of each column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = [(T.ByteType(), 8), (T.ShortType(), 16), (T.IntegerType(), 32), (T.LongType(), 64)]
_FLOAT32_MAX = float.fromhex("0x1.fffffep+127")
_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def _narrowed(dtype: T.DataType, low: object, high: object) -> T.DataType:
    if low is None:
        return dtype
    if isinstance(dtype, T.IntegralType):
        for candidate, bits in _INTEGERS:
            if low > -(2 ** (bits - 1)) and high < 2 ** (bits - 1) - 1:
                return candidate
        return dtype
    inside = low > -_FLOAT32_MAX and high < _FLOAT32_MAX
    return T.FloatType() if inside else T.DoubleType()


def _choices(df: DataFrame) -> dict[str, tuple[T.DataType, T.DataType]]:
    fields = [f for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.FractionalType))]
    fields = [f for f in fields if not isinstance(f.dataType, T.DecimalType)]
    if not fields:
        return {}
    bounds = df.agg(
        *[g(F.col(f.name)).alias(f"{g.__name__}_{i}") for i, f in enumerate(fields) for g in (F.min, F.max)]
    ).first()
    return {
        f.name: (f.dataType, _narrowed(f.dataType, bounds[f"min_{i}"], bounds[f"max_{i}"]))
        for i, f in enumerate(fields)
    }


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast numeric columns to the narrowest type; one pass over the table.

    The bounds are strict, so a column that reaches 127 is already a smallint.
    Meant for storage: keep doubles for arithmetic.
    """
    chosen = _choices(df)
    return df.select(
        *[F.col(c).cast(chosen[c][1]).alias(c) if c in chosen else F.col(c) for c in df.columns]
    )


def narrowing_report(df: DataFrame) -> DataFrame:
    """Per numeric column: old type, new type, bytes before and after, percent saved."""
    chosen = _choices(df)
    n = df.count()
    rows = [
        (c, old.simpleString(), new.simpleString(),
         n * _WIDTH[old.simpleString()], n * _WIDTH[new.simpleString()])
        for c, (old, new) in chosen.items()
    ]
    report = df.sparkSession.createDataFrame(
        rows, "column string, old_type string, new_type string, old_bytes long, new_bytes long"
    )
    saved = F.try_divide((F.col("old_bytes") - F.col("new_bytes")) * 100.0, F.col("old_bytes"))
    return report.withColumn("percent_saved", F.round(saved, 1))
