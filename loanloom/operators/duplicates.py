"""D-1, D-2: repeated rows and repeated keys, after the first.

What repeats is found by prints, 128 bits of the columns compared, so that rows which occur once are never shuffled. Rows
whose print occurs twice are then compared as values, so a clash of prints costs time only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.operators.lookup import BROADCAST_ROWS, MIN_HOT_ROWS, bounded
from loanloom.sources.io import checkpoint


_PRINTS = ["_print1", "_print2"]


def _repeated_prints(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with their prints, and the prints of more than one row with their number.

    The pass that finds them shuffles prints alone, combined on the map side.
    """
    # Which fields are missing is part of the print, since a hash passes over missing ones.
    prints = [F.xxhash64(F.lit(s), *[F.struct(F.col(c).isNull(), F.col(c)) for c in columns]) for s in (1, 2)]
    marked = df.select(*df.columns, *[p.alias(n) for p, n in zip(prints, _PRINTS)])
    counted = marked.groupBy(*_PRINTS).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return marked, checkpoint(counted)


def _repeated_rows(marked: DataFrame, repeated: DataFrame, max_prints: int) -> DataFrame:
    """Rows of repeated prints, kept where they are; all rows if the prints are no short list, since most would move anyway."""
    few, fits = bounded(repeated.select(*_PRINTS), max_prints)
    return marked.join(F.broadcast(few), _PRINTS, "left_semi") if fits else marked


def duplicate_rows(df: DataFrame, max_prints: int = BROADCAST_ROWS) -> DataFrame:
    """D-1: every distinct row that repeats, with how many copies follow the first.

    Copies are identical, so a count carries all of them; ``expand_copies``
    turns it back into rows.
    """
    # Rows of two columns are hardly wider than their prints and are compared at once.
    rows = df if len(df.columns) <= 2 else _repeated_rows(*_repeated_prints(df, df.columns), max_prints)
    return (
        rows.groupBy(*df.columns)
        .agg((F.count(F.lit(1)) - 1).alias("n_after_first"))
        .where(F.col("n_after_first") > 0)
    )


def expand_copies(duplicates: DataFrame, chunk: int = 100_000) -> DataFrame:
    """One row per repeated copy.

    A row with very many copies is first cut into chunks, which are spread over
    the tasks before any copy is written.
    """
    n = F.col("n_after_first")
    rows = [c for c in duplicates.columns if c != "n_after_first"]
    chunks = duplicates.withColumn("_start", F.explode(F.sequence(F.lit(0), n - 1, F.lit(chunk))))
    spread = chunks.repartition(*rows, "_start")
    copies = F.explode(F.sequence(F.lit(1), F.least(F.lit(chunk), n - F.col("_start"))))
    return spread.select(*rows, copies.alias("_copy")).drop("_copy")


def duplicate_keys(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    min_hot_rows: int = MIN_HOT_ROWS,
    max_prints: int = BROADCAST_ROWS,
) -> DataFrame:
    """D-2: all rows of a key but the first in the given order, missing keys being alike.

    Rows that tie in the order follow their other columns, and exact copies of the
    first row count as rows after it. Keys are compared as values, not as text. Rows meet once, by their
    key, and are numbered there; those of keys with ``min_hot_rows`` rows or more, which would be sorted in one task, are
    counted as whole rows and compared with the first row of their key, a map-side combined minimum.
    """
    marked, repeated = _repeated_prints(df, keys)
    rows = _repeated_rows(marked, repeated, max_prints)
    order = [*order_by, *[c for c in df.columns if c not in order_by]]
    hot = repeated.where(F.col("_n") >= min_hot_rows).select("_print1").collect()
    is_hot = F.col("_print1").isin([r[0] for r in hot]) if hot else F.lit(False)
    numbered = rows.where(~is_hot).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    after = numbered.where("_place > 1").select(*df.columns)
    return after.unionByName(_after_first_of_hot(rows.where(is_hot).select(*df.columns), keys, order)) if hot else after


def _after_first_of_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    distinct = df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("n_after_first"))
    # A struct matches another with the same missing fields, which a plain key would not.
    keyed = distinct.withColumns({"_key": F.struct(*keys), "_order": F.struct(*order)})
    firsts = keyed.groupBy("_key").agg(F.min("_order").alias("_first"))
    joined = keyed.join(F.broadcast(firsts), "_key")  # a row per hot key
    is_first = F.col("_order") == F.col("_first")
    counted = joined.select(*df.columns, (F.col("n_after_first") + F.when(is_first, 0).otherwise(1)).alias("n_after_first"))
    return expand_copies(counted.where("n_after_first > 0"))
