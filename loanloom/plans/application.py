"""Applicant features and clean-up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.expr import safe_div
from loanloom.operators.clean import fill_constant, fill_mode, null_sentinel, replace_value
from loanloom.operators.encode import Vocabulary, apply_one_hot, fit_vocabulary
from loanloom.operators.fit import SourceFit, fit_source
from loanloom.operators.lookup import bounded, split_join
from loanloom.operators.quantiles import group_median

# Fills and substitutions of the applicant table.
NOT_AVAILABLE = "Data_Not_Available"
NOT_AVAILABLE_COLUMNS = (
    "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "FLAG_MOBIL", "FLAG_EMP_PHONE",
    "FLAG_CONT_MOBILE", "FLAG_EMAIL", "OCCUPATION_TYPE",
)
ZERO_FILLED = ("AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")
DROPPED_DOCUMENTS = (2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21)
# Median income lookups, category column to feature name.
MEDIAN_FEATURES = {
    "NAME_CONTRACT_TYPE": "MEDIAN_INCOME_CONTRACT_TYPE",
    "NAME_TYPE_SUITE": "MEDIAN_INCOME_SUITE_TYPE",
    "NAME_HOUSING_TYPE": "MEDIAN_INCOME_HOUSING_TYPE",
    "ORGANIZATION_TYPE": "MEDIAN_INCOME_ORG_TYPE",
    "OCCUPATION_TYPE": "MEDIAN_INCOME_OCCU_TYPE",
    "NAME_EDUCATION_TYPE": "MEDIAN_INCOME_EDU_TYPE",
}


def _named_categories(df: DataFrame) -> DataFrame:
    """The part of the clean-up that looks at nothing but the row; the rest changes no category."""
    fills = {c: NOT_AVAILABLE for c in NOT_AVAILABLE_COLUMNS}
    fills |= {"NAME_TYPE_SUITE": "Unaccompanied"}
    df = fill_constant(df, fills)
    df = replace_value(df, "CODE_GENDER", {"XNA": "M"})
    return replace_value(df, "NAME_FAMILY_STATUS", {"Unknown": "Married"})


def clean_application(df: DataFrame, sentinel_scope: str = "column", fit: SourceFit | None = None) -> DataFrame:
    """Missing categories named, odd categories merged, employment sentinel removed."""
    df = _named_categories(df)
    if fit is None:
        fit = fit_source(df, {"DAYS_EMPLOYED": F.col("DAYS_EMPLOYED")}, ["CNT_FAM_MEMBERS"], levels=[])
    df = fill_mode(df, ["CNT_FAM_MEMBERS"], fit.modes)
    df = null_sentinel(df, "DAYS_EMPLOYED", sentinel_scope, fit.maxima, keys=["SK_ID_CURR"])
    return fill_constant(df, {c: 0 for c in ZERO_FILLED})


def application_ratios(df: DataFrame, mode: str = "null") -> DataFrame:
    """Seventeen row-level features."""

    def per(num: str, den: str):
        return safe_div(num, den, mode)

    df = df.withColumns(
        {
            "CREDIT_INCOME_PERCENT": per("AMT_CREDIT", "AMT_INCOME_TOTAL"),
            "ANNUITY_INCOME_PERCENT": per("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
            "CREDIT_ANNUITY_PERCENT": per("AMT_CREDIT", "AMT_ANNUITY"),
            "FAMILY_CNT_INCOME_PERCENT": per("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
            "CREDIT_TERM": per("AMT_ANNUITY", "AMT_CREDIT"),
            "BIRTH_EMPLOYED_PERCENT": per("DAYS_EMPLOYED", "DAYS_BIRTH"),
            "CHILDREN_CNT_INCOME_PERCENT": per("AMT_INCOME_TOTAL", "CNT_CHILDREN"),
            "CREDIT_GOODS_DIFF": F.col("AMT_CREDIT") - F.col("AMT_GOODS_PRICE"),
            "EMPLOYED_REGISTRATION_PERCENT": per("DAYS_EMPLOYED", "DAYS_REGISTRATION"),
            "BIRTH_REGISTRATION_PERCENT": per("DAYS_BIRTH", "DAYS_REGISTRATION"),
            "ID_REGISTRATION_DIFF": F.col("DAYS_ID_PUBLISH") - F.col("DAYS_REGISTRATION"),
            "CAR_AGE_EMP_PERCENT": per("OWN_CAR_AGE", "DAYS_EMPLOYED"),
            "CAR_AGE_BIRTH_PERCENT": per("OWN_CAR_AGE", "DAYS_BIRTH"),
            "PHONE_CHANGE_EMP_PERCENT": per("DAYS_LAST_PHONE_CHANGE", "DAYS_EMPLOYED"),
            "PHONE_CHANGE_BIRTH_PERCENT": per("DAYS_LAST_PHONE_CHANGE", "DAYS_BIRTH"),
        }
    )
    # Age when the loan is paid off: years lived plus months of credit left.
    age = F.col("DAYS_BIRTH") * F.lit(-1.0 / 365) + F.col("CREDIT_ANNUITY_PERCENT") * F.lit(1.0 / 12)
    return df.withColumns(
        {
            "ANNUITY_LENGTH_EMPLOYED_PERCENT": per("CREDIT_TERM", "DAYS_EMPLOYED"),
            "AGE_LOAN_FINISH": age,
        }
    )


@dataclass(frozen=True)
class ApplicationFit:
    """What is learned from train and reused on test: median incomes and category levels."""

    medians: DataFrame
    medians_small: bool
    vocabulary: Vocabulary


def clean_and_fit(df: DataFrame, sentinel_scope: str = "column") -> tuple[DataFrame, ApplicationFit]:
    """C8 and everything F1 learns, in two passes: one for all facts, one for the medians."""
    named = _named_categories(df)
    facts = fit_source(
        named, {"DAYS_EMPLOYED": F.col("DAYS_EMPLOYED")}, ["CNT_FAM_MEMBERS"], missing=False, spread_of="AMT_INCOME_TOTAL"
    )
    cleaned = clean_application(df, sentinel_scope, facts)
    return cleaned, fit_application(cleaned, vocabulary=facts.vocabulary, most_distinct=facts.spread)


def fit_application(
    df: DataFrame, approx: bool = False, vocabulary: Vocabulary | None = None, most_distinct: int | None = None
) -> ApplicationFit:
    """Median income per level of six category columns, together in one grouped pass."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in MEDIAN_FEATURES
    ]
    long = df.select("AMT_INCOME_TOTAL", F.inline(F.array(*pairs)))
    medians, small = bounded(group_median(long, "AMT_INCOME_TOTAL", ["column", "level"], approx, most_distinct))
    return ApplicationFit(medians, small, vocabulary or fit_vocabulary(df, missing=False))


def attach_median_incomes(df: DataFrame, fit: ApplicationFit) -> DataFrame:
    """Median income of the row's category, six lookups."""
    for column, name in MEDIAN_FEATURES.items():
        table = fit.medians.where(F.col("column") == column).select(
            F.col("level").alias(column), F.col("median").alias(name)
        )
        df = df.join(F.broadcast(table), column, "left") if fit.medians_small else split_join(df, table, [column])
    return df


def application_features(
    df: DataFrame,
    fit: ApplicationFit | None = None,
    mode: str = "null",
    keep: Sequence[str] = (),
) -> DataFrame:
    """ratios, median incomes, document flags dropped, categories one-hot encoded."""
    fit = fit_application(df) if fit is None else fit
    order = df.columns
    df = attach_median_incomes(application_ratios(df, mode), fit)
    derived = [c for c in df.columns if c not in order]
    df = df.select(*order, *derived).withColumns(
        {
            "ORG_TYPE_INCOME_PERCENT": safe_div("MEDIAN_INCOME_ORG_TYPE", "AMT_INCOME_TOTAL", mode),
            "OCCU_TYPE_INCOME_PERCENT": safe_div("MEDIAN_INCOME_OCCU_TYPE", "AMT_INCOME_TOTAL", mode),
            "EDU_TYPE_INCOME_PERCENT": safe_div("MEDIAN_INCOME_EDU_TYPE", "AMT_INCOME_TOTAL", mode),
        }
    )
    df = df.drop(*[f"FLAG_DOCUMENT_{n}" for n in DROPPED_DOCUMENTS if f"FLAG_DOCUMENT_{n}" not in keep])
    return apply_one_hot(df, fit.vocabulary)
