"""Per-group statistics and feature blocks attached to rows.

Statistics are aggregated first (combined on the map side) and joined back. A
window over the key would gather all rows of a hot key in one task; the join
keeps such rows where they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.operators.lookup import MIN_HOT_ROWS, hot_keys, split_join


def attach_stats(
    df: DataFrame,
    keys: str | Sequence[str],
    stats: Mapping[str, Column],
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Every row gets its group's statistics; rows with a missing key get NULL."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    grouped = df
    for k in keys:
        grouped = grouped.where(F.col(k).isNotNull())
    grouped = grouped.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return split_join(df, grouped, keys, "left", min_hot_rows).select(*df.columns, *stats)


def attach_stats_in_place(
    df: DataFrame,
    keys: Sequence[str],
    stats: Mapping[str, Column],
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """As ``attach_stats``, for wide rows and small groups: a window, which ships the rows once, or not at all if those
    of one key lie together already.

    Rows of hot keys take the way of ``attach_stats``, so no window is over one; rows with a missing key are windows of their own.
    ``stats`` must be aggregates that windows allow, so none of distinct values.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    hashed = F.xxhash64(*keys)
    hot = hot_keys(df.where(known).select(hashed.alias("_hash")), "_hash", min_rows=min_hot_rows)
    is_hot = known & hashed.isin(hot)
    apart = F.when(~known, F.xxhash64(*df.columns))
    by = Window.partitionBy(*keys, apart)
    result = (df.where(~is_hot) if hot else df).withColumns({n: F.when(known, c.over(by)) for n, c in stats.items()})
    if not hot:
        return result
    many = df.where(is_hot)
    few = F.broadcast(many.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]))
    return result.unionByName(many.join(few, list(keys), "left").select(*df.columns, *stats))


def left_join_blocks(base: DataFrame, blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Blocks with one row per key joined to the base, which keeps its rows."""
    for block in blocks:
        base = base.join(block, key, "left")
    return base


def join_with_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join where only the right-hand columns that collide are renamed."""
    taken = {c.lower() for c in left.columns}
    renamed = right.select(
        key,
        *[
            F.col(c).alias(c + suffix if c.lower() in taken else c)
            for c in right.columns
            if c != key
        ],
    )
    return left.join(renamed, key, "left")
