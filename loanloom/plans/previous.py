"""Earlier applications at the same lender."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.aggspec import AggSpec
from loanloom.functions.expr import safe_div
from loanloom.operators.clean import null_max, sentinel_values
from loanloom.operators.encode import Vocabulary
from loanloom.operators.fit import SourceFit, fit_source, sized_facts
from loanloom.operators.recency import DAY_SLICES, Block, recency_features, roll_up

# Day columns with sentinels, and the statistics per applicant.
SENTINEL_COLUMNS = ("DAYS_FIRST_DRAWING",)
ZERO_AND_SENTINEL_COLUMNS = (
    "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION",
)
STATS = {
    "AMT_ANNUITY": ["max", "mean"],
    "AMT_APPLICATION": ["max", "mean"],
    "AMT_CREDIT": ["max", "mean"],
    "AMT_DOWN_PAYMENT": ["max", "mean"],
    "AMT_GOODS_PRICE": ["mean", "sum"],
    "HOUR_APPR_PROCESS_START": ["max", "mean"],
    "RATE_DOWN_PAYMENT": ["max", "mean"],
    "RATE_INTEREST_PRIMARY": ["max", "mean"],
    "RATE_INTEREST_PRIVILEGED": ["max", "mean"],
    "DAYS_DECISION": ["max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
    "DAYS_FIRST_DRAWING": ["max", "mean"],
    "DAYS_TERMINATION": ["max", "mean"],
    "APPLICATION_CREDIT_RATIO": ["max", "mean"],
    "DOWN_PAYMENT_TO_CREDIT": ["max", "mean"],
    "DAYS_LAST_DUE_DIFF": ["max", "mean"],
}


def fit_previous(df: DataFrame) -> SourceFit:
    """Sentinels, levels and rows of the raw table in one pass."""
    return fit_source(df, sentinel_values(SENTINEL_COLUMNS) | sentinel_values(ZERO_AND_SENTINEL_COLUMNS, zero_is_missing=True))


def clean_previous(df: DataFrame, fit: SourceFit | None = None) -> DataFrame:
    """Sentinel days become missing."""
    fit = fit or fit_previous(df)
    df = null_max(df, SENTINEL_COLUMNS, maxima=fit.maxima)
    return null_max(df, ZERO_AND_SENTINEL_COLUMNS, zero_is_missing=True, maxima=fit.maxima)


def previous_loan_features(df: DataFrame, mode: str = "null") -> DataFrame:
    """Row-level features; those the statistics do not read are pruned by Spark."""
    credit, n = F.col("AMT_CREDIT"), F.col("CNT_PAYMENT")
    interest = safe_div(safe_div(F.col("AMT_ANNUITY") * n, credit, mode) - 1, n, mode)
    return df.withColumns(
        {
            "APPLICATION_CREDIT_DIFF": F.col("AMT_APPLICATION") - credit,
            "APPLICATION_CREDIT_RATIO": safe_div("AMT_APPLICATION", credit, mode),
            "CREDIT_TO_ANNUITY_RATIO": safe_div(credit, "AMT_ANNUITY", mode),
            "DOWN_PAYMENT_TO_CREDIT": safe_div("AMT_DOWN_PAYMENT", credit, mode),
            "SIMPLE_INTERESTS": interest,
            "DAYS_LAST_DUE_DIFF": F.col("DAYS_LAST_DUE_1ST_VERSION") - F.col("DAYS_LAST_DUE"),
        }
    )


def previous_block(vocabulary: Vocabulary, mode: str = "null") -> Block:
    """All, approved and refused applications in one aggregation."""
    numeric, dummies = AggSpec(STATS), vocabulary.dummies()
    return Block.of(
        numeric | AggSpec({n: ["mean"] for n in dummies}, dummies),
        prefix="PREV_",
        segments={
            "CS_APP_": (numeric, "NAME_CONTRACT_STATUS = 'Approved'"),
            "CS_REF_": (numeric, "NAME_CONTRACT_STATUS = 'Refused'"),
        },
        prepare=lambda df: previous_loan_features(df, mode),
    )


def previous_features(df: DataFrame, hot=None, mode: str = "null", fit: SourceFit | None = None) -> DataFrame:
    """F4; ``fit`` of the raw table saves a pass."""
    vocabulary, hot, rows = sized_facts(df, fit, None, hot)
    return roll_up(df, "SK_ID_CURR", previous_block(vocabulary, mode), hot, rows)


def previous_recency(
    df: DataFrame,
    strategy: str = "tagged",
    slices=DAY_SLICES,
    hot=None,
    vocabulary: Vocabulary | None = None,
    mode: str = "null",
    fit: SourceFit | None = None,
) -> DataFrame:
    """Seven look-back slices on the decision day; ``fit`` of the raw table saves a pass."""
    vocabulary, hot, rows = sized_facts(df, fit, vocabulary, hot)
    block = previous_block(vocabulary, mode)
    return recency_features(df, "SK_ID_CURR", "DAYS_DECISION", slices, block, strategy, hot, rows)
