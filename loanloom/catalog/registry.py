"""Query registry and the rounding shared by both engines."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.plans import roles
from loanloom.plans.roles import Roles


@dataclass(frozen=True)
class Query:
    run: Callable[[Roles], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Roles(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the role tables under a name, with its SQL twin."""

    def register(run: Callable[[Roles], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(run, None if sql is None else with_roles(sql))
        return run

    return register


# --- role tables in SQL -----------------------------------------------------------------------


def _sql_days(column: str, anchor: str) -> str:
    return f"date_diff('day', {anchor}, CAST({column} AS DATE))"


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_SUMS = f"({_select(roles.LINE_SUMS, 'lineitem')} GROUP BY l_orderkey) ls"
_ROLE_SQL = {
    "application": _select(roles.application(_sql_days), "customer"),
    "bureau": _select(roles.bureau(_sql_days), "orders"),
    "bureau_balance": _select(roles.bureau_balance(_sql_days), "lineitem"),
    "previous": _select(roles.previous(_sql_days), f"orders LEFT JOIN {_SUMS} ON o_orderkey = ls_orderkey"),
    "pos": _select(roles.pos(_sql_days), _LINES),
    "instalments": _select(roles.instalments(_sql_days), _LINES),
    "card": _select(roles.card(_sql_days), "events"),
}


def with_roles(sql: str) -> str:
    """Prefix definitions of the role tables the statement names as ``{role}``."""
    used = [r for r in _ROLE_SQL if "{" + r + "}" in sql]
    for r in used:
        sql = sql.replace("{" + r + "}", f"role_{r}")
    if not used:
        return sql
    defined = ", ".join(f"role_{r} AS ({_ROLE_SQL[r]})" for r in used)
    body = re.match(r"\s*WITH\s+(.*)", sql, re.S)
    return f"WITH {defined}, {body.group(1)}" if body else f"WITH {defined} {sql}"


# --- rounding ---------------------------------------------------------------------------------


# Values are cut to four decimals at a boundary that simple fractions never lie on, so a
# last-digit difference between summation orders cannot change the outcome.
_SHIFT = "0.41421356"


def r4(column: Column | str) -> Column:
    """Four decimals by plain arithmetic, which both engines do alike."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column.cast("double") * 10000.0 + float(_SHIFT)) / F.lit(10000.0)


def sql_r4(expr: str) -> str:
    return f"(floor(CAST({expr} AS DOUBLE) * 10000e0 + {_SHIFT}e0) / 10000e0)"


def sql_rv(expr: str) -> str:
    big = sql_r4("v / 1000000e0")
    body = f"CASE WHEN abs(v) >= 1000000e0 THEN {big} ELSE {sql_r4('v')} END"
    return f"list_transform([{expr}], lambda v: {body})[1]"


_VARIANCE = re.compile(r"_(VAR|var)(_|$)")


def rounded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys as they are, every other column cut to four decimals.

    Variances beyond a million are cut in units of a million.
    """

    def cut(c: str) -> str:
        plain = f"floor(CAST(`{c}` AS DOUBLE) * 10000D + {_SHIFT}D) / 10000D"
        if not _VARIANCE.search(c):
            return plain
        in_millions = f"floor(CAST(`{c}` AS DOUBLE) / 1000000D * 10000D + {_SHIFT}D) / 10000D"
        return f"CASE WHEN abs(`{c}`) >= 1000000D THEN {in_millions} ELSE {plain} END"

    return df.selectExpr(*keys, *[f"{cut(c)} AS `{c}`" for c in df.columns if c not in keys])


def sql_rounded(inner: str, keys: Sequence[str]) -> str:
    kept = ", ".join(keys)
    listed = ", ".join(f"'{k}'" for k in keys)
    var = "regexp_matches(c, '_(VAR|var)(_|$)')"
    plain_columns = f"COLUMNS(lambda c: c NOT IN ({listed}) AND NOT {var})"
    body = f"{kept}, {sql_r4(plain_columns)}"
    if re.search(r"_(VAR|var)(_|\b)", inner):
        var_columns = f"CAST(COLUMNS(lambda c: {var}) AS DOUBLE)"
        body += f", {sql_rv(var_columns)}"
    return f"SELECT {body} FROM ({inner}) t"
