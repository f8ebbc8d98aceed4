"""Declarative aggregation: ``{column: [stat, ...]}`` compiled to named Spark columns.

Specs compile to SQL text, one expression per feature. With hundreds of features
per table this keeps building the plan cheap.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# {x}: the value, masked to the segment. Sums and counts are 0, not missing, without values.
_STATS = {
    "min": "min({x})",
    "max": "max({x})",
    "mean": "avg({x})",
    "var": "var_samp({x})",
    "sum": "coalesce(sum({x}), 0)",
    "count": "count({x})",
    "size": "count(1)",
    "nunique": "count(DISTINCT {x})",
}
_ZERO_WHEN_EMPTY = {"sum", "count", "size", "nunique"}


# Variance states (n, mean, sum of squared deviations) of disjoint sets of rows, merged by the pairwise rule.
_PAIRWISE = (
    "aggregate(collect_list({s}), named_struct('n', 0L, 'm', 0D, 'd', 0D), (a, b) -> IF(b.n = 0, a, named_struct("
    "'n', a.n + b.n, 'm', a.m + (b.m - a.m) * b.n / (a.n + b.n), 'd', a.d + b.d + (b.m - a.m) * (b.m - a.m) * a.n * b.n / (a.n + b.n))))"
)


@dataclass
class Mergeable:
    """Aggregates taken apart: states of rows, how states merge, and what the merged states give, all as SQL text."""

    rows: dict[str, str] = field(default_factory=dict)
    merges: dict[str, str] = field(default_factory=dict)
    finals: dict[str, str] = field(default_factory=dict)
    _names: dict[str, str] = field(default_factory=dict)

    def state(self, of_rows: str, merge: str) -> str:
        """Column of a state; the same state of several features is kept once."""
        name = self._names.setdefault(of_rows, f"_m{len(self._names)}")
        self.rows[name], self.merges[name] = of_rows, merge.format(s=f"`{name}`")
        return f"`{name}`"

    def add(self, name: str, stat: str, value: str, where: str | None) -> None:
        masked = value if where is None else f"CASE WHEN {where} THEN {value} END"
        total = lambda x: self.state(x, "sum({s})")
        if stat in ("min", "max"):
            final = self.state(f"{stat}({masked})", stat + "({s})")
        elif stat == "sum":
            final = f"coalesce({total(f'sum({masked})')}, 0)"
        elif stat == "count":
            final = total(f"count({masked})")
        elif stat == "size":
            final = total("count(1)" if where is None else f"count_if({where})")
        elif stat == "mean":
            final = f"try_divide(CAST({total(f'sum({masked})')} AS DOUBLE), {total(f'count({masked})')})"
        elif stat == "var":
            x = f"CAST({masked} AS DOUBLE)"
            spread = f"coalesce(var_pop({x}) * count({x}), 0D)"
            s = self.state(f"named_struct('n', count({x}), 'm', coalesce(avg({x}), 0D), 'd', {spread})", _PAIRWISE)
            final = f"IF({s}.n > 1, {s}.d / ({s}.n - 1), NULL)"
        else:
            raise ValueError(f"{stat} of disjoint rows does not merge")
        if where is not None and stat in _ZERO_WHEN_EMPTY:
            final = f"CASE WHEN {total(f'count_if({where})')} > 0 THEN {final} END"
        self.finals[name] = final


class AggSpec:
    """Ordered ``{name: [stat, ...]}``; ``exprs`` gives names that are SQL expressions.

    ``AggSpec(...) | AggSpec(...)`` merges, the right side winning on repeated names.
    """

    def __init__(
        self, spec: Mapping[str, Iterable[str]], exprs: Mapping[str, str] | None = None
    ) -> None:
        self.spec = {name: tuple(stats) for name, stats in spec.items()}
        self.exprs = dict(exprs or {})
        unknown = {s for stats in self.spec.values() for s in stats} - set(_STATS)
        if unknown:
            raise ValueError(f"unknown stats {sorted(unknown)}")

    def __or__(self, other: AggSpec) -> AggSpec:
        return AggSpec({**self.spec, **other.spec}, {**self.exprs, **other.exprs})

    @classmethod
    def every(cls, columns: Iterable[str], stats: Iterable[str]) -> AggSpec:
        """The same stats for every column."""
        stats = tuple(stats)
        return cls({c: stats for c in columns})

    def names(self, prefix: str = "", suffix: str = "", upper: bool = True) -> list[str]:
        return [
            f"{prefix}{name}_{stat.upper() if upper else stat}{suffix}"
            for name, stats in self.spec.items()
            for stat in stats
        ]

    def columns(
        self, prefix: str = "", suffix: str = "", upper: bool = True, where: str | None = None
    ) -> list[Column]:
        """Aliased aggregates; ``where`` restricts every one of them to a segment.

        A segment without rows is a join miss, so its sums and counts are NULL too.
        """
        names = iter(self.names(prefix, suffix, upper))
        columns = []
        for name, stats in self.spec.items():
            value = self.exprs.get(name, f"`{name}`")
            for stat in stats:
                columns.append(F.expr(f"{self._aggregate(stat, value, where)} AS `{next(names)}`"))
        return columns

    def take_apart(self, into: Mergeable, prefix: str = "", where: str | None = None, upper: bool = True) -> None:
        """The aggregates of ``columns`` as states that merge."""
        names = iter(self.names(prefix, "", upper))
        for name, stats in self.spec.items():
            for stat in stats:
                into.add(next(names), stat, self.exprs.get(name, f"`{name}`"), where)

    @staticmethod
    def _aggregate(stat: str, value: str, where: str | None) -> str:
        if where is None:
            return _STATS[stat].format(x=value)
        if stat == "size":
            value_or_count = f"count_if({where})"
        else:
            value_or_count = _STATS[stat].format(x=f"CASE WHEN {where} THEN {value} END")
        if stat in _ZERO_WHEN_EMPTY:
            return f"CASE WHEN count_if({where}) > 0 THEN {value_or_count} END"
        return value_or_count
