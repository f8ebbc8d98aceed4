"""loans at other lenders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.aggspec import AggSpec
from loanloom.functions.expr import ordinal_code, safe_div
from loanloom.operators.attach import attach_stats
from loanloom.operators.clean import fill_constant
from loanloom.operators.encode import Vocabulary, fit_vocabulary
from loanloom.operators.fit import sized_facts
from loanloom.operators.recency import Block, roll_up

# Codes of the credit state, and the statistics per applicant.
CREDIT_CODES = {"Closed": 0, "Active": 1}
OTHER_CREDIT_CODE = 2
LOAN_STATS = {
    "AMT_CREDIT_SUM_DEBT": ["mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean", "sum"],
    "DAYS_CREDIT": ["mean", "var"],
    "DAYS_CREDIT_UPDATE": ["mean", "min"],
    "CREDIT_DAY_OVERDUE": ["mean", "min"],
    "DAYS_CREDIT_ENDDATE": ["mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean", "max"],
    "AMT_ANNUITY": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM": ["mean", "sum", "max"],
}
ZERO_FILLED = ("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_ANNUITY")


def bureau_loan_features(df: DataFrame, mode: str = "null") -> DataFrame:
    """Row-level features, before missing amounts become 0."""
    end, credit, debt = F.col("DAYS_CREDIT_ENDDATE"), F.col("AMT_CREDIT_SUM"), F.col("AMT_CREDIT_SUM_DEBT")
    return df.withColumns(
        {
            "CREDIT_DURATION": -F.col("DAYS_CREDIT") + end,
            "ENDDATE_DIFF": end - F.col("DAYS_ENDDATE_FACT"),
            "UPDATE_DIFF": end - F.col("DAYS_CREDIT_UPDATE"),
            "DEBT_PERCENTAGE": safe_div(credit, debt, mode),
            "DEBT_CREDIT_DIFF": credit - debt,
            "CREDIT_TO_ANNUITY_RATIO": safe_div(credit, "AMT_ANNUITY", mode),
            "DEBT_TO_ANNUITY_RATIO": safe_div(debt, "AMT_ANNUITY", mode),
            "CREDIT_OVERDUE_DIFF": credit - F.col("AMT_CREDIT_SUM_OVERDUE"),
        }
    )


def bureau_customer_features(df: DataFrame, mode: str = "null") -> DataFrame:
    """loan features plus counts, type mix and totals of the applicant on every loan."""
    df = bureau_loan_features(df, mode)
    df = df.withColumn("CREDIT_TYPE_CODE", ordinal_code("CREDIT_ACTIVE", CREDIT_CODES, OTHER_CREDIT_CODE))
    df = fill_constant(df, {c: 0 for c in ZERO_FILLED})
    df = attach_stats(
        df,
        "SK_ID_CURR",
        {
            "CUSTOMER_LOAN_COUNT": F.count("SK_ID_BUREAU"),
            "CUSTOMER_CREDIT_TYPES": F.count_distinct("CREDIT_TYPE"),
            "CUSTOMER_CREDIT_CODE_MEAN": F.avg("CREDIT_TYPE_CODE"),
            "TOTAL_CREDIT_SUM": F.coalesce(F.sum("AMT_CREDIT_SUM"), F.lit(0)),
            "TOTAL_DEBT_SUM": F.coalesce(F.sum("AMT_CREDIT_SUM_DEBT"), F.lit(0)),
        },
    )
    return df.withColumns(
        {
            "AVG_LOAN_TYPE": safe_div("CUSTOMER_LOAN_COUNT", "CUSTOMER_CREDIT_TYPES", mode),
            "CREDIT_DEBT_RATIO": safe_div("TOTAL_CREDIT_SUM", "TOTAL_DEBT_SUM", mode),
        }
    )


def balance_features(
    balance: DataFrame, vocabulary: Vocabulary | None = None, months: bool = False
) -> DataFrame:
    """History length and category shares per loan.

    ``months`` adds min, max and mean of the month offset and the sizes per
    category, which nothing in the applicant matrix reads.
    """
    vocabulary = fit_vocabulary(balance) if vocabulary is None else vocabulary
    dummies = vocabulary.dummies()
    stats = ["min", "max", "mean", "size"]
    spec = AggSpec({"MONTHS_BALANCE": stats if months else ["size"]})
    spec |= AggSpec({n: stats if months else stats[:3] for n in dummies}, dummies)
    return balance.where(F.col("SK_ID_BUREAU").isNotNull()).groupBy("SK_ID_BUREAU").agg(*spec.columns())


def bureau_block(
    loan_vocabulary: Vocabulary, balance_vocabulary: Vocabulary, include_active: bool = True
) -> Block:
    """All loans, active loans and closed loans of an applicant in one aggregation."""
    numeric = AggSpec(LOAN_STATS)
    dummies = loan_vocabulary.dummies()
    overall = numeric | AggSpec({n: ["max"] for n in dummies}, dummies)
    for n in balance_vocabulary.dummies():
        overall |= AggSpec({f"{n}_{s}": [s.lower()] for s in ("MEAN", "MIN", "MAX")})
    segments = {"C_": (numeric, "CREDIT_ACTIVE = 'Closed'")}
    if include_active:
        segments = {"A_": (numeric, "CREDIT_ACTIVE = 'Active'"), **segments}

    def aggregate(df: DataFrame, by: list[str]) -> DataFrame:
        columns = overall.columns("BUREAU_", upper=False)
        for prefix, (spec, condition) in segments.items():
            columns += spec.columns(prefix, where=condition)
        return df.groupBy(*by).agg(*columns)

    return Block(aggregate)


def bureau_features(
    bureau: DataFrame,
    balance: DataFrame,
    include_active: bool = True,
    hot: Sequence[object] | None = None,
) -> DataFrame:
    """one row per applicant from loans and their monthly balances."""
    # Looked for before the join, which cannot change how often an applicant occurs.
    loan_vocabulary, hot, rows = sized_facts(bureau, None, None, hot)
    balance_vocabulary = fit_vocabulary(balance)
    # Rows without a loan id match nothing, so they stay where they are.
    filled = fill_constant(bureau, {c: 0 for c in ZERO_FILLED})
    balances = balance_features(balance, balance_vocabulary)
    with_id = filled.where("SK_ID_BUREAU IS NOT NULL").join(balances, "SK_ID_BUREAU", "left")
    loans = with_id.unionByName(filled.where("SK_ID_BUREAU IS NULL"), allowMissingColumns=True)
    return roll_up(loans, "SK_ID_CURR", bureau_block(loan_vocabulary, balance_vocabulary, include_active), hot, rows)
