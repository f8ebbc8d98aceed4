"""Monthly credit card balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.aggspec import AggSpec
from loanloom.functions.expr import flag, safe_div
from loanloom.operators.encode import Vocabulary
from loanloom.operators.fit import sized_facts
from loanloom.operators.recency import MONTH_SLICES, Block, recency_features, roll_up

STATS = ("max", "mean", "sum", "var")
_KEYS = {"SK_ID_CURR", "SK_ID_PREV"}


def card_row_features(df: DataFrame, mode: str = "null") -> DataFrame:
    """C11, X14, X20."""
    limit = F.col("AMT_CREDIT_LIMIT_ACTUAL")
    return df.withColumnRenamed("AMT_RECIVABLE", "AMT_RECEIVABLE").withColumns(
        {
            "LIMIT_USE": safe_div("AMT_BALANCE", limit, mode),
            "PAYMENT_DIV_MIN": safe_div("AMT_PAYMENT_CURRENT", "AMT_INST_MIN_REGULARITY", mode),
            "LATE_PAYMENT": flag(F.col("SK_DPD") > 0),
            "DRAWING_LIMIT_RATIO": safe_div("AMT_DRAWINGS_ATM_CURRENT", limit, mode),
        }
    )


def card_block(columns: list[str], vocabulary: Vocabulary, mode: str = "null") -> Block:
    """Every column and every category indicator, four statistics each."""
    numeric = [c for c in columns if c not in vocabulary.levels and c not in _KEYS]
    dummies = vocabulary.dummies()
    spec = AggSpec.every(numeric, STATS) | AggSpec({n: STATS for n in dummies}, dummies)
    return Block.of(spec, prefix="CR_", count_as="CREDIT_COUNT", prepare=lambda df: card_row_features(df, mode))


def _block(df: DataFrame, vocabulary: Vocabulary, mode: str = "null") -> Block:
    return card_block(card_row_features(df).columns, vocabulary, mode)


def card_features(df: DataFrame, hot=None, mode: str = "null") -> DataFrame:
    """F7."""
    vocabulary, hot, rows = sized_facts(df, None, None, hot)
    return roll_up(df, "SK_ID_CURR", _block(df, vocabulary, mode), hot, rows)


def card_recency(
    df: DataFrame,
    offset: str = "MONTHS_BALANCE",
    strategy: str = "tagged",
    slices=MONTH_SLICES,
    hot=None,
    vocabulary: Vocabulary | None = None,
    mode: str = "null",
) -> DataFrame:
    """Five look-back slices on the balance month."""
    vocabulary, hot, rows = sized_facts(df, None, vocabulary, hot)
    return recency_features(df, "SK_ID_CURR", offset, slices, _block(df, vocabulary, mode), strategy, hot, rows)
