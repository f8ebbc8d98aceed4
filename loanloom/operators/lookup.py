"""Small-table joins that check the size before broadcasting, and hot-key detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
# A key with fewer rows than this never overloads a task.
MIN_HOT_ROWS = 1_000_000


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Materialise a result that is expected to be small.

    Fetches at most ``max_rows + 1`` rows. If all fit, they become a local
    relation, whose known size lets every later join broadcast it without
    recomputing. Otherwise the frame comes back as it was, to be shuffled.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Attach a table with one row per key, by broadcast if small, else by ``split_join``."""
    small, fits = bounded(table, max_rows)
    keys = [on] if isinstance(on, str) else list(on)
    if fits:
        return df.join(F.broadcast(small), keys, how)
    return split_join(df, table, keys, how)


def split_join(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Left or inner join with a table that has one row per key, safe for hot keys.

    Adaptive execution splits a skewed join only if both sides come straight
    from a shuffle, which an aggregated side does not. So rows of hot keys are
    set apart and meet their few table rows by broadcast, without a shuffle; the
    rest is shuffled. Rows with a missing key count as one key.
    """
    keys = list(keys)
    hashed = F.xxhash64(*keys)
    hot = hot_keys(df.select(hashed.alias("_hash")), "_hash", min_rows=min_hot_rows)
    if not hot:
        return df.join(table, keys, how)
    is_hot = hashed.isin(hot)
    few = F.broadcast(table.where(is_hot))
    return df.where(~is_hot).join(table.where(~is_hot), keys, how).unionByName(
        df.where(is_hot).join(few, keys, how)
    )


# Below this share of the rows a frequent-items sketch would hold too many items, and all keys are counted.
_LEAST_SUPPORT = 1e-4


def hot_keys(df: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS) -> list[object]:
    """Keys with at least ``min_rows`` rows, whatever share of the table that is.

    There can be at most ``rows / min_rows`` of them. Where that is a short list, a
    sketch that cannot miss one finds candidates without a shuffle and exact counts
    confirm them; otherwise every key is counted, combined on the map side.
    """
    present = df.select(key).where(F.col(key).isNotNull())
    total = present.count()
    if total < min_rows:
        return []
    support = min_rows / total
    if support >= _LEAST_SUPPORT:
        candidates = [k for k in present.stat.freqItems([key], support=support).first()[0]]
        if not candidates:
            return []
        present = present.where(F.col(key).isin(candidates))
    confirmed = present.groupBy(key).count().where(F.col("count") >= min_rows)
    return sorted(row[key] for row in confirmed.collect())
