"""Nested look-back slices of a detail table, rolled up to one row per key.

The rows are shuffled once, by the key. After that shuffle each row is tagged
with the slices it belongs to, so every slice of every key is aggregated in the
same stage and a slice without rows is simply absent, which is what a left join
would give. Keys that hold a large share of the table take a second way, with
partial aggregation before the shuffle, so no task receives all their rows.

How many tasks share the shuffled rows goes by the number of rows. Adaptive execution goes by shuffled bytes, which are few,
while an aggregate over several slices holds some two kilobytes for each of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.aggspec import AggSpec, Mergeable
from loanloom.operators.lookup import hot_keys

DAY_SLICES = {
    "": None, "_year": 365, "_half_year": 182, "_quarter": 90,
    "_month": 30, "_fortnight": 14, "_week": 7,
}
MONTH_SLICES = {"": None, "_year": 12, "_half_year": 6, "_quarter": 3, "_month": 1}


@dataclass(frozen=True)
class Block:
    """How rows become features.

    ``prepare`` derives columns row by row, after the shuffle so they are not
    shipped; ``aggregate(rows, by)`` returns one row per combination of ``by``. A block that is a single aggregation also has
    ``measures(where, suffix)``, which allows the one-pass form.
    """

    aggregate: Callable[[DataFrame, list[str]], DataFrame]
    measures: Callable[[str | None, str], list[Column]] | None = None
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df
    mergeable: Callable[[], Mergeable] | None = None

    @classmethod
    def of(
        cls,
        spec: AggSpec,
        prefix: str = "",
        segments: Mapping[str, tuple[AggSpec, str]] | None = None,
        count_as: str | None = None,
        prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    ) -> Block:
        """A block from specs: ``segments`` maps a name prefix to a spec and its condition."""

        def measures(where: str | None = None, suffix: str = "") -> list[Column]:
            columns = spec.columns(prefix, suffix, where=where)
            for seg_prefix, (seg_spec, condition) in (segments or {}).items():
                both = condition if where is None else f"({where}) AND ({condition})"
                columns += seg_spec.columns(seg_prefix, suffix, where=both)
            if count_as:
                size = AggSpec({count_as: ["size"]}).columns(where=where)[0]
                columns.append(size.alias(f"{count_as}{suffix}"))
            return columns

        def mergeable() -> Mergeable:
            parts = Mergeable()
            spec.take_apart(parts, prefix)
            for seg_prefix, (seg_spec, condition) in (segments or {}).items():
                seg_spec.take_apart(parts, seg_prefix, condition)
            if count_as:
                parts.add(count_as, "size", "1", None)
            return parts

        return cls(lambda df, by: df.groupBy(*by).agg(*measures()), measures, prepare, mergeable)


def _in_slice(offset: str | None, bound: int | None) -> str:
    return "TRUE" if bound is None else f"`{offset}` >= -{bound}"


def recency_features(
    detail: DataFrame,
    key: str,
    offset: str | None,
    slices: Mapping[str, int | None],
    block: Block,
    strategy: str = "tagged",
    hot: Sequence[object] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Features per key, each column repeated per slice with the slice's suffix.

    ``slices`` maps a suffix to a bound N (``offset >= -N``) or ``None`` for all
    rows. ``strategy``: ``tagged`` (one shuffle, wide blocks), ``bands`` (one shuffle, every row aggregated
    once, for blocks whose aggregates merge and keys with many rows), ``one_pass``
    (conditional aggregates, narrow blocks) or ``naive`` (filter, aggregate and
    join per slice; the yardstick for tests). ``rows``: how many the detail has, if known; else they may be counted.
    """
    detail = detail.where(F.col(key).isNotNull())
    if all(bound is not None for bound in slices.values()):
        # Without an all-time slice older rows need not be read or shuffled.
        detail = detail.where(_in_slice(offset, max(slices.values())))
    if strategy == "tagged":
        return _tagged(detail, key, offset, slices, block, hot, rows)
    if strategy == "bands":
        return _banded(detail, key, offset, slices, block, hot, rows)
    if strategy == "one_pass":
        return _one_pass(detail, key, offset, slices, block)
    if strategy == "naive":
        return _naive(detail, key, offset, slices, block)
    raise ValueError(f"unknown strategy {strategy!r}")


# Rows a task gets after the shuffle.
ROWS_PER_TASK = 250_000


def _by_key(detail: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows shuffled by key, over as many tasks as their number asks for; few rows as adaptive execution likes.

    The number is a multiple of the session's shuffle partitions, so every task writes one bucket of a table that has as many
    buckets as those.
    """
    if rows <= ROWS_PER_TASK:
        return detail.repartition(key)
    parts = int(detail.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return detail.repartition(parts * math.ceil(rows / ROWS_PER_TASK / parts), key)


def _side_by_side(long: DataFrame, key: str, slices: Mapping[str, int | None]) -> DataFrame:
    """Rows per key and ``_slice`` to one row per key with the columns of every slice."""
    features = [c for c in long.columns if c not in (key, "_slice")]
    # At most one entry per slice; a slice the key has no rows in is absent, hence NULL.
    packed = f"struct({', '.join(f'`{f}`' for f in features)})"
    wide = long.groupBy(key).agg(
        F.expr(f"map_from_entries(collect_list(struct(_slice, {packed}))) AS _slices")
    )
    wide = wide.selectExpr(f"`{key}`", *[f"_slices[{i}] AS _s{i}" for i in range(len(slices))])
    return wide.selectExpr(
        f"`{key}`", *[f"_s{i}.`{f}` AS `{f}{s}`" for i, s in enumerate(slices) for f in features]
    )


# Tasks that share the rows of a hot key.
SALTS = 64


def _banded(detail, key, offset, slices, block, hot, rows):
    """Every row belongs to one band, the youngest slice it is in, and is aggregated there once, into states that merge.

    A slice is the sum of its band and all younger ones. Rows of hot keys are dealt over ``SALTS`` tasks in the same
    exchange as all others; their states, few per key, are merged in a second, small one. Both halves read the same
    shuffled rows, so the table is read and shipped once.
    """
    if block.mergeable is None:
        raise ValueError("bands need a block whose aggregates merge")
    parts, hot = block.mergeable(), hot_keys(detail, key) if hot is None else list(hot)
    n_rows = detail.count() if rows is None else rows
    young_first = sorted(slices, key=lambda s: float("inf") if slices[s] is None else slices[s])
    tests = [f"WHEN {_in_slice(offset, slices[s])} THEN {i}" for i, s in enumerate(young_first)]
    numbers = {s: i for i, s in enumerate(slices)}
    members = ", ".join(f"named_struct('band', {i}, 'slice', {numbers[s]})" for i, s in enumerate(young_first))

    def merged(states: DataFrame, by: str) -> DataFrame:
        wider = f"filter(array({members}), m -> m.band >= _band).slice"
        each = states.withColumn("_slice", F.explode(F.expr(wider)))
        long = each.groupBy(by, "_slice").agg(*[F.expr(f"{m} AS `{n}`") for n, m in parts.merges.items()])
        long = long.selectExpr(f"`{by}`", "_slice", *[f"{f} AS `{n}`" for n, f in parts.finals.items()])
        return _side_by_side(long, by, slices)

    def banded(rows: DataFrame, by: str) -> DataFrame:
        rows = block.prepare(rows).withColumn("_band", F.expr(f"CASE {' '.join(tests)} END"))
        return rows.groupBy(by, "_band").agg(*[F.expr(f"{r} AS `{n}`") for n, r in parts.rows.items()])

    if not hot:
        return merged(banded(_by_key(detail, key, n_rows), key), key)
    # All rows of a key lie in one place, but those of a hot key in ``SALTS`` places.
    salt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*detail.columns), F.lit(SALTS))).otherwise(0)
    placed = detail.withColumn("_place", F.struct(F.col(key).alias("key"), salt.alias("salt")))
    states = banded(_by_key(placed, "_place", n_rows), "_place")
    # Adding zero in a way that is no constant keeps Spark from moving the test below the exchange, which would make it two.
    is_hot = F.col("_place.key").isin(hot).cast("int") + F.floor(F.rand(0))
    cold = merged(states.where(is_hot == 0), "_place")
    cold = cold.select(F.col("_place.key").alias(key), *[c for c in cold.columns if c != "_place"])
    return cold.unionByName(merged(states.where(is_hot == 1).withColumn(key, F.col("_place.key")), key))


def _tagged(detail, key, offset, slices, block, hot, rows):
    hot = hot_keys(detail, key) if hot is None else list(hot)
    n_rows = detail.count() if rows is None else rows

    def rolled(rows: DataFrame) -> DataFrame:
        rows = block.prepare(rows)
        marks = ", ".join(
            f"CASE WHEN {_in_slice(offset, bound)} THEN {i} END" for i, bound in enumerate(slices.values())
        )
        tagged = rows.withColumn("_slice", F.expr(f"explode(array_compact(array({marks})))"))
        return _side_by_side(block.aggregate(tagged, [key, "_slice"]), key, slices)

    if not hot:
        return rolled(_by_key(detail, key, n_rows))
    is_hot = F.col(key).isin(hot)
    return rolled(_by_key(detail.where(~is_hot), key, n_rows)).unionByName(rolled(detail.where(is_hot)))


def _one_pass(detail, key, offset, slices, block):
    if block.measures is None:
        raise ValueError("one_pass needs a block that is a single aggregation")
    columns = []
    for suffix, bound in slices.items():
        where = None if bound is None else _in_slice(offset, bound)
        columns += block.measures(where, suffix)
    return block.prepare(detail).groupBy(key).agg(*columns)


def _naive(detail, key, offset, slices, block):
    result = detail.select(key).distinct()
    for suffix, bound in slices.items():
        part = block.aggregate(block.prepare(detail.where(_in_slice(offset, bound))), [key])
        part = part.selectExpr(f"`{key}`", *[f"`{c}` AS `{c}{suffix}`" for c in part.columns if c != key])
        result = result.join(part, key, "left")
    return result


def roll_up(
    detail: DataFrame, key: str, block: Block, hot: Sequence[object] | None = None, rows: int | None = None
) -> DataFrame:
    """A block over all rows of each key, without slices; ``rows`` as for ``recency_features``."""
    detail = detail.where(F.col(key).isNotNull())
    hot = hot_keys(detail, key) if hot is None else list(hot)
    n_rows = detail.count() if rows is None else rows

    def rolled(rows: DataFrame) -> DataFrame:
        return block.aggregate(block.prepare(rows), [key])

    if not hot:
        return rolled(_by_key(detail, key, n_rows))
    is_hot = F.col(key).isin(hot)
    return rolled(_by_key(detail.where(~is_hot), key, n_rows)).unionByName(rolled(detail.where(is_hot)))
