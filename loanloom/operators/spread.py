"""Tasks in step with the rows. A file below one split is one task whatever is computed from it, so a small file of many
rows keeps one core busy while the rest wait, and all its rows, when cached, are read by one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

# Rows a task gets.
ROWS_PER_TASK = 50_000


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Rows dealt by key over as many tasks as their number asks for, sorted there; a frame of few rows as it is.

    Where a row goes depends on the rows alone, not on files or cores, so what samples by task gives the same on every run.
    ``rows``: how many there are, if known; else they are counted.
    """
    tasks = math.ceil((df.count() if rows is None else rows) / ROWS_PER_TASK)
    return df.repartition(tasks, key).sortWithinPartitions(key) if tasks > 1 else df
