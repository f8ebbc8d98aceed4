"""A whole table's profile, all columns, in two scans.

The first scan is one aggregate: rows, missing and known values, extremes, moments and a KLL sketch
of every number. The sketches bracket all quantiles of all columns; the second scan counts the values
inside the brackets, and what lies outside by its side only, so that the quantiles are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.expr import is_missing

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}
# Bytes that the sketches of all columns may take in a task; a sketch holds about three values per unit of its size.
_SKETCH_BYTES = 64 << 20
_LEAST_SIZE, _MOST_SIZE = 256, 32_768
# Rank error of a sketch times its size, rounded up, and the share of it a bracket allows on either side.
_ERROR, _SLACK = 3.0, 2.0
# Shares at which a bracket that is narrowed is cut.
_GRID = 512
# Values that one bracket may leave to be ranked; wider brackets are sketched again.
RANKED = 5_000_000


class ColumnStats(NamedTuple):
    """What one scan tells of a column; moments and extremes of numbers only."""

    column: str
    dtype: str
    n_rows: int
    n_miss: int
    constant: bool
    mean: float | None
    std: float | None
    low: float | None
    high: float | None


class _Bracket(NamedTuple):
    low: float
    high: float
    held: float  # values inside, at most, as far as is known


def _number(df: DataFrame, column: str, kind: str) -> Column:
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value) if kind in ("float", "double") else value


def _size(columns: int) -> int:
    fits = _SKETCH_BYTES // (24 * max(columns, 1))
    return max(_LEAST_SIZE, min(_MOST_SIZE, 1 << max(fits, 1).bit_length() - 1))


class TableProfile:
    """Statistics of all columns, fetched once; ``quantiles`` makes the second scan."""

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None, size: int | None = None):
        kinds = dict(df.dtypes)
        self.df, self.columns = df, list(columns or df.columns)
        self.numbers = [c for c in self.columns if kinds[c] in NUMERIC]
        self.size = size or _size(len(self.numbers))
        aggregates = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(self.columns):
            known = F.when(~is_missing(f"`{c}`", kinds[c]), F.col(f"`{c}`"))
            ordered = not kinds[c].startswith(("map", "variant"))
            aggregates += [
                F.count(known).alias(f"known_{i}"),
                (F.min(known).eqNullSafe(F.max(known)) if ordered else F.lit(False)).alias(f"constant_{i}"),
            ]
            if c in self.numbers:
                value = _number(df, c, kinds[c])
                aggregates += [
                    F.avg(value).alias(f"mean_{i}"), F.stddev_samp(value).alias(f"std_{i}"),
                    F.min(value).alias(f"low_{i}"), F.max(value).alias(f"high_{i}"),
                    F.kll_sketch_agg_double(value, self.size).alias(f"sketch_{i}"),
                ]
        row = df.agg(*aggregates).first().asDict()
        self.rows = row["rows"]
        self.stats = [
            ColumnStats(
                c, kinds[c], self.rows, self.rows - row[f"known_{i}"], row[f"constant_{i}"],
                *[row.get(f"{f}_{i}") for f in ("mean", "std", "low", "high")],
            )
            for i, c in enumerate(self.columns)
        ]
        self._sketches = {c: row[f"sketch_{i}"] for i, c in enumerate(self.columns) if c in self.numbers}
        self._kinds = kinds

    # --- tables ---

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.df.sparkSession.createDataFrame(rows, schema)

    @property
    def shape(self) -> tuple[int, int]:
        """S5."""
        return self.rows, len(self.columns)

    def missing(self, with_dtype: bool = True) -> DataFrame:
        """P11 (P12 without ``dtype``), T2: columns with missing values, most missing first."""
        some = sorted((s for s in self.stats if s.n_miss), key=lambda s: (-s.n_miss, s.column))
        table = self._table(
            [(i, s.column, s.dtype, s.n_miss, self.rows) for i, s in enumerate(some)],
            "i int, column string, dtype string, n_miss long, n_rows long",
        )
        ratio = F.round(F.col("n_miss") / F.col("n_rows") * 100, 2).alias("ratio")
        return table.orderBy("i").select("column", *(["dtype"] if with_dtype else []), "n_miss", ratio)

    def constants(self) -> list[str]:
        """At most one distinct value, missing ones left out."""
        return [s.column for s in self.stats if s.constant]

    def check(self, probs: Sequence[float]) -> DataFrame:
        """Type and missing count of every column, quantiles of the numbers."""
        found, names = self.quantiles(probs), _names(probs)
        rows = [(s.column, s.dtype, s.n_miss, *found.get(s.column, [None] * len(probs))) for s in self.stats]
        return self._table(rows, "column string, dtype string, n_miss long" + _doubles(names))

    def describe(self, probs: Sequence[float]) -> DataFrame:
        """Count, mean, deviation, extremes and quantiles of the numbers."""
        found, names = self.quantiles(probs), _names(probs)
        rows = [
            (s.column, self.rows - s.n_miss, s.mean, s.std, s.low, s.high, *found[s.column])
            for s in self.stats
            if s.column in self._sketches
        ]
        return self._table(rows, "column string, count long" + _doubles(["mean", "std", "min", "max", *names]))

    # --- exact quantiles ---

    def quantiles(self, probs: Sequence[float], ranked: int = RANKED) -> dict[str, list[float | None]]:
        """Quantiles by linear interpolation per column, NULL for columns without values.

        Brackets that hold more than ``ranked`` values are sketched again from the values
        inside, in one scan for all of them, until none does. Brackets that miss a rank (a sketch is only
        probably right) are widened to all values and narrowed anew.
        """
        probs = [float(p) for p in probs]
        stats = {s.column: s for s in self.stats}
        known = {c: stats[c].n_rows - stats[c].n_miss for c in self.numbers}
        full = [c for c in self.numbers if known[c]]
        wanted = {
            (c, j): (math.floor(p * (known[c] - 1)), min(math.floor(p * (known[c] - 1)) + 1, known[c] - 1))
            for c in full
            for j, p in enumerate(probs)
        }
        brackets = self._first_brackets(probs, full, stats, known)
        everything = {c: _Bracket(stats[c].low, stats[c].high, known[c]) for c in full}
        values: dict[tuple[str, int], float] = {}
        while brackets:
            wide = {k: b for k, b in brackets.items() if b.held > ranked and b.low < b.high}
            if wide:
                brackets |= self._narrowed(wide, wanted, known, everything)
                continue
            ranks = {c: sorted({r for k, pair in wanted.items() if k[0] == c and k in brackets for r in pair}) for c in full}
            values |= self._ranked(brackets, {c: r for c, r in ranks.items() if r})
            # Ranks outside their brackets start again from all values; a bracket found right is done.
            missed = [k for k in brackets if any((k[0], r) not in values for r in wanted[k])]
            brackets = {k: everything[k[0]] for k in missed}
            ranked = max([ranked, *[b.held for b in brackets.values()]]) if missed else ranked
        found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in self.numbers}
        for (c, j), (first, last) in wanted.items():
            low, high = values[c, first], values[c, last]
            part = probs[j] * (known[c] - 1) - first
            found[c][j] = low if low == high or part == 0 else low + (high - low) * part
        return found

    def _cuts(self, sketches: list[bytes], shares: Sequence[float]) -> list[list[float]]:
        """The sketches' values at these shares."""
        table = self._table([(i, bytearray(b)) for i, b in enumerate(sketches)], "i int, sketch binary")
        cut = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(x)) for x in shares]))
        found = {r["i"]: r["q"] for r in table.select("i", cut.alias("q")).collect()}
        return [found[i] for i in range(len(sketches))]

    def _first_brackets(self, probs, full, stats, known) -> dict[tuple[str, int], _Bracket]:
        slack = _SLACK * _ERROR / self.size
        edges = [min(max(e, 0.0), 1.0) for p in probs for e in (p - slack, p + slack)]
        # So few values that neighbours may lie outside a bracket are all counted.
        many = [c for c in full if known[c] * slack >= 2]
        cuts = dict(zip(many, self._cuts([self._sketches[c] for c in many], edges) if many else []))
        result = {}
        for c in full:
            for j in range(len(probs)):
                down, up = edges[2 * j], edges[2 * j + 1]
                low = stats[c].low if c not in cuts or down <= 0 else cuts[c][2 * j]
                high = stats[c].high if c not in cuts or up >= 1 else cuts[c][2 * j + 1]
                result[c, j] = _Bracket(low, high, known[c] * (up - down) if c in cuts else known[c])
        return result

    def _narrowed(self, wide, wanted, known, everything) -> dict[tuple[str, int], _Bracket]:
        """Each wide bracket cut down by a sketch of the values inside; all in one scan."""
        keys, aggregates = list(wide), []
        size = _size(len(keys))
        for i, (c, _) in enumerate(keys):
            value, b = _number(self.df, c, self._kinds[c]), wide[keys[i]]
            inside = F.when((value >= b.low) & (value <= b.high), value)
            aggregates += [
                F.count_if(value < b.low).alias(f"below_{i}"), F.count(inside).alias(f"inside_{i}"),
                F.kll_sketch_agg_double(inside, size).alias(f"sketch_{i}"),
            ]
        row = self.df.agg(*aggregates).first()
        result, asked = {}, []
        for i, key in enumerate(keys):
            below, inside = row[f"below_{i}"], row[f"inside_{i}"]
            first, last = (r - below for r in wanted[key])
            if first < 0 or last >= inside:
                result[key] = everything[key[0]]
                continue
            slack = max(_SLACK * _ERROR / size, 2.0 / inside)
            down = max(0, math.floor((first / inside - slack) * _GRID))
            up = min(_GRID, math.ceil(((last + 1) / inside + slack) * _GRID))
            asked.append((key, down, up, inside, row[f"sketch_{i}"]))
        cuts = self._cuts([a[4] for a in asked], [g / _GRID for g in range(_GRID + 1)]) if asked else []
        for (key, down, up, inside, _), cut in zip(asked, cuts):
            old = wide[key]
            low, high = old.low if down == 0 else cut[down], old.high if up == _GRID else cut[up]
            # Where no cut helps, few values repeat very often and there are few counts of them.
            stuck = (low, high) == (old.low, old.high)
            result[key] = _Bracket(low, high, 0 if stuck else inside * (up - down) / _GRID)
        return result

    def _ranked(self, brackets, ranks) -> dict[tuple[str, int], float]:
        """``(column, rank) -> value`` for the ranks that fall inside the brackets, in one scan.

        A value inside a bracket is counted as itself, one outside only by the gap it lies in.
        """
        columns, place = list(ranks), None
        for i, c in enumerate(columns):
            spans: list[list[float]] = []
            for b in sorted(b for key, b in brackets.items() if key[0] == c):
                if spans and b.low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b.high)
                else:
                    spans.append([b.low, b.high])
            gaps = None
            for k, (low, high) in enumerate(spans):
                for at, hit in ((2 * k, F.col("v") < low), (2 * k + 1, F.col("v") <= high)):
                    gaps = F.when(hit, at) if gaps is None else gaps.when(hit, at)
            gaps, mine = gaps.otherwise(2 * len(spans)), F.col("i") == i
            place = F.when(mine, gaps) if place is None else place.when(mine, gaps)
        # Generated rows first, so that a column's expression is not repeated in every comparison.
        pairs = [F.struct(F.lit(i).alias("i"), _number(self.df, c, self._kinds[c]).alias("v")) for i, c in enumerate(columns)]
        counted = (
            self.df.select(F.inline(F.array(*pairs)))
            .where("v IS NOT NULL")
            .withColumn("place", place)
            .groupBy("i", "place", F.when(F.col("place") % 2 == 1, F.col("v")).alias("v"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        order = Window.partitionBy("i").orderBy("place", "v").rowsBetween(Window.unboundedPreceding, 0)
        upto = counted.withColumn("upto", F.sum("n").over(order)).where("v IS NOT NULL")
        want = F.element_at(F.array(*[F.array(*[F.lit(r).cast("long") for r in ranks[c]]) for c in columns]), F.col("i") + 1)
        hit = upto.select("i", "v", F.filter(want, lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto"))).alias("r"))
        return {(columns[r["i"]], rank): r["v"] for r in hit.where("size(r) > 0").collect() for rank in r["r"]}


def _names(probs: Sequence[float]) -> list[str]:
    return [f"q{round(p * 100):02d}" for p in probs]


def _doubles(names: Sequence[str]) -> str:
    return "".join(f", {n} double" for n in names)
