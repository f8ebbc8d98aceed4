"""Column expressions and aggregation specs."""

from loanloom.functions.aggspec import AggSpec
from loanloom.functions.expr import (
    clip_at_zero,
    dummy,
    finite_or_zero,
    flag,
    null_if_value,
    ordinal_code,
    safe_div,
    sql_literal,
)
from loanloom.functions.names import clean_name, unique_names

__all__ = [
    "AggSpec",
    "clean_name",
    "clip_at_zero",
    "dummy",
    "finite_or_zero",
    "flag",
    "null_if_value",
    "ordinal_code",
    "safe_div",
    "sql_literal",
    "unique_names",
]
