"""Cleaning, encoding and row-level features."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.catalog.registry import query, r4, rounded, sql_r4, sql_rounded
from loanloom.functions import clean_name, ordinal_code, safe_div
from loanloom.operators import clean, encode
from loanloom.plans.application import (
    application_ratios,
    attach_median_incomes,
    clean_application,
    fit_application,
)
from loanloom.plans.bureau import bureau_loan_features
from loanloom.plans.card import card_row_features
from loanloom.plans.instalments import instalment_row_features, late_columns
from loanloom.plans.pos import pos_row_features
from loanloom.plans.previous import clean_previous, previous_loan_features

# --- cleaning ---------------------------------------------------------------------------------


@query(
    "c1_constant_fill",
    """SELECT SK_ID_CURR, coalesce(NAME_FAMILY_STATUS, 'Data_Not_Available') AS NAME_FAMILY_STATUS,
       coalesce(OCCUPATION_TYPE, 'Data_Not_Available') AS OCCUPATION_TYPE,
       CAST(FLAG_CONT_MOBILE AS BIGINT) AS FLAG_CONT_MOBILE FROM {application}""",
)
def _(t):
    fill = "Data_Not_Available"
    filled = clean.fill_constant(
        t.application, {"NAME_FAMILY_STATUS": fill, "OCCUPATION_TYPE": fill, "FLAG_CONT_MOBILE": fill}
    )
    return filled.select(
        "SK_ID_CURR", "NAME_FAMILY_STATUS", "OCCUPATION_TYPE", F.col("FLAG_CONT_MOBILE").cast("long")
    )


@query(
    "c2_mode_fill",
    """WITH top AS (SELECT CREDIT_TYPE AS v FROM {bureau} WHERE CREDIT_TYPE IS NOT NULL
         GROUP BY CREDIT_TYPE ORDER BY count(*) DESC, CREDIT_TYPE LIMIT 1)
       SELECT SK_ID_BUREAU, coalesce(CREDIT_TYPE, (SELECT v FROM top)) AS CREDIT_TYPE FROM {bureau}""",
)
def _(t):
    return clean.fill_mode(t.bureau, ["CREDIT_TYPE"]).select("SK_ID_BUREAU", "CREDIT_TYPE")


@query(
    "c3_zero_fill",
    """SELECT SK_ID_BUREAU, coalesce(AMT_CREDIT_SUM, 0) AS AMT_CREDIT_SUM,
       coalesce(AMT_CREDIT_SUM_DEBT, 0) AS AMT_CREDIT_SUM_DEBT, coalesce(AMT_ANNUITY, 0) AS AMT_ANNUITY FROM {bureau}""",
)
def _(t):
    columns = ["AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_ANNUITY"]
    return clean.fill_constant(t.bureau, {c: 0 for c in columns}).select("SK_ID_BUREAU", *columns)


@query(
    "c4_sentinel_table",
    """WITH top AS (SELECT max(DAYS_EMPLOYED) AS m FROM {application})
       SELECT SK_ID_CURR, CAST(nullif(DAYS_EMPLOYED, (SELECT m FROM top)) AS BIGINT) AS DAYS_EMPLOYED,
       nullif(AMT_CREDIT, (SELECT m FROM top)) AS AMT_CREDIT FROM {application}""",
)
def _(t):
    cleaned = clean.null_sentinel(t.application, "DAYS_EMPLOYED", scope="all", keys=["SK_ID_CURR"])
    return cleaned.select("SK_ID_CURR", F.col("DAYS_EMPLOYED").cast("long"), "AMT_CREDIT")


@query(
    "c5_sentinel_max",
    """SELECT SK_ID_PREV, nullif(DAYS_FIRST_DRAWING, (SELECT max(DAYS_FIRST_DRAWING) FROM {previous}))
       AS DAYS_FIRST_DRAWING FROM {previous}""",
)
def _(t):
    return clean.null_max(t.previous, ["DAYS_FIRST_DRAWING"]).select("SK_ID_PREV", "DAYS_FIRST_DRAWING")


_ZERO_MAX = ("DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION")


def sql_clean_previous() -> str:
    """The previous-application role with its sentinels removed."""
    tops = ", ".join(f"max(nullif({c}, 0)) AS m_{c}" for c in _ZERO_MAX)
    cleaned = ", ".join(f"nullif(nullif({c}, 0), m_{c}) AS {c}" for c in _ZERO_MAX)
    return f"""(SELECT p.* REPLACE (nullif(DAYS_FIRST_DRAWING, m_DAYS_FIRST_DRAWING) AS DAYS_FIRST_DRAWING, {cleaned})
        FROM {{previous}} p, (SELECT max(DAYS_FIRST_DRAWING) AS m_DAYS_FIRST_DRAWING, {tops} FROM {{previous}}) m)"""


@query(
    "c6_sentinel_null",
    f"SELECT SK_ID_PREV, DAYS_FIRST_DRAWING, {', '.join(_ZERO_MAX)} FROM {sql_clean_previous()}",
)
def _(t):
    return clean_previous(t.previous).select("SK_ID_PREV", "DAYS_FIRST_DRAWING", *_ZERO_MAX)


@query(
    "c7_replace_value",
    """SELECT SK_ID_CURR, CASE WHEN CODE_GENDER = 'XNA' THEN 'M' ELSE CODE_GENDER END AS CODE_GENDER,
       CASE WHEN NAME_FAMILY_STATUS = 'Unknown' THEN 'Married' ELSE NAME_FAMILY_STATUS END AS NAME_FAMILY_STATUS
       FROM {application}""",
)
def _(t):
    replaced = clean.replace_value(t.application, "CODE_GENDER", {"XNA": "M"})
    replaced = clean.replace_value(replaced, "NAME_FAMILY_STATUS", {"Unknown": "Married"})
    return replaced.select("SK_ID_CURR", "CODE_GENDER", "NAME_FAMILY_STATUS")


def sql_clean_application() -> str:
    """The applicant role cleaned."""
    named = ("NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE")
    zero = ("AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")
    changes = {c: f"coalesce({c}, 'Data_Not_Available')" for c in named}
    changes["NAME_FAMILY_STATUS"] = (
        "CASE coalesce(NAME_FAMILY_STATUS, 'Data_Not_Available') WHEN 'Unknown' THEN 'Married' "
        "ELSE coalesce(NAME_FAMILY_STATUS, 'Data_Not_Available') END"
    )
    changes |= {c: f"coalesce({c}, 0)" for c in zero}
    changes["NAME_TYPE_SUITE"] = "coalesce(NAME_TYPE_SUITE, 'Unaccompanied')"
    changes["CODE_GENDER"] = "CASE WHEN CODE_GENDER = 'XNA' THEN 'M' ELSE CODE_GENDER END"
    changes["DAYS_EMPLOYED"] = "nullif(DAYS_EMPLOYED, (SELECT max(DAYS_EMPLOYED) FROM {application}))"
    changes["CNT_FAM_MEMBERS"] = (
        "coalesce(CNT_FAM_MEMBERS, (SELECT CNT_FAM_MEMBERS FROM {application} WHERE CNT_FAM_MEMBERS IS NOT NULL "
        "GROUP BY CNT_FAM_MEMBERS ORDER BY count(*) DESC, CNT_FAM_MEMBERS LIMIT 1))"
    )
    body = ", ".join(f"{e} AS {c}" for c, e in changes.items())
    return f"(SELECT * REPLACE ({body}) FROM {{application}})"


_C8 = (
    "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE", "NAME_TYPE_SUITE", "CODE_GENDER",
    "CNT_FAM_MEMBERS", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
)


@query(
    "c8_clean_application",
    f"""SELECT SK_ID_CURR, {', '.join(_C8)}, CAST(DAYS_EMPLOYED AS BIGINT) AS DAYS_EMPLOYED
        FROM {sql_clean_application()} a""",
)
def _(t):
    return clean_application(t.application).select("SK_ID_CURR", *_C8, F.col("DAYS_EMPLOYED").cast("long"))


@query(
    "c11_project_drop_rename",
    "SELECT SK_ID_CURR, AMT_RECIVABLE AS AMT_RECEIVABLE, AMT_BALANCE FROM {card}",
)
def _(t):
    chosen = t.card.select("SK_ID_CURR", "SK_ID_PREV", "AMT_RECIVABLE", "AMT_BALANCE")
    return chosen.withColumnRenamed("AMT_RECIVABLE", "AMT_RECEIVABLE").drop("SK_ID_PREV")


@query(
    "c12_segment_filter",
    "SELECT SK_ID_BUREAU, SK_ID_CURR FROM {bureau} WHERE CREDIT_ACTIVE = 'Active'",
)
def _(t):
    return t.bureau.where(F.col("CREDIT_ACTIVE") == "Active").select("SK_ID_BUREAU", "SK_ID_CURR")


@query(
    "c13_recency_filter",
    "SELECT SK_ID_PREV, CAST(DAYS_DECISION AS BIGINT) AS DAYS_DECISION FROM {previous} WHERE DAYS_DECISION >= -182",
)
def _(t):
    recent = t.previous.where(F.col("DAYS_DECISION") >= -182)
    return recent.select("SK_ID_PREV", F.col("DAYS_DECISION").cast("long"))


@query("c14_dedup_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    orders = t.table("orders")
    doubled = orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", (F.col("o_custkey") + 1).alias("o_custkey")
    )
    return clean.first_of_each_name(doubled)


@query("c15_split_label", "SELECT SK_ID_CURR, CAST(TARGET AS BIGINT) AS TARGET FROM {application}")
def _(t):
    _features, label = clean.split_label(t.application, "TARGET", "SK_ID_CURR")
    return label.select("SK_ID_CURR", F.col("TARGET").cast("long"))


@query(
    "c16_finite_matrix",
    f"""SELECT SK_ID_CURR, {sql_r4("coalesce(AMT_ANNUITY, 0)")} AS AMT_ANNUITY,
        CASE WHEN CNT_CHILDREN = 0 AND DAYS_ID_PUBLISH = 0 THEN CAST(0 AS DOUBLE)
             WHEN CNT_CHILDREN = 0 THEN CAST(-1.7976931348623157e308 AS DOUBLE)
             ELSE {sql_r4("CAST(DAYS_ID_PUBLISH AS DOUBLE) / CNT_CHILDREN")} END AS ratio
        FROM {{application}}""",
)
def _(t):
    raw = t.application.select(
        "SK_ID_CURR", "AMT_ANNUITY", safe_div("DAYS_ID_PUBLISH", "CNT_CHILDREN", mode="ieee").alias("ratio")
    )
    finite = clean.finite_matrix(raw, ["AMT_ANNUITY", "ratio"])
    extreme = F.abs("ratio") > 1e300
    return finite.select(
        "SK_ID_CURR",
        r4("AMT_ANNUITY").alias("AMT_ANNUITY"),
        F.when(extreme, F.col("ratio")).otherwise(r4("ratio")).alias("ratio"),
    )


@query("c17_name_pattern", "SELECT CAST(FLAG_MOBIL AS BIGINT) AS FLAG_MOBIL, CAST(FLAG_CONT_MOBILE AS BIGINT) AS FLAG_CONT_MOBILE FROM {application}")
def _(t):
    matched = clean.columns_like(t.application, "MOBIL")
    return matched.select(*[F.col(c).cast("long").alias(c) for c in matched.columns])


# --- encoding ---------------------------------------------------------------------------------


def sql_dummies(column: str, values: list[str], missing: bool) -> str:
    """Indicator columns of one category column."""
    parts = [
        f"CAST(CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS {clean_name(f'{column}_{v}')}"
        for v in values
    ]
    if missing:
        parts.append(f"CAST(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END AS BIGINT) AS {column}_nan")
    return ", ".join(parts)


def _long(df, keep):
    return df.select(*keep, *[F.col(c).cast("long").alias(c) for c in df.columns if c not in keep])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


@query(
    "e1_onehot_na",
    f"""SELECT SK_ID_BUREAU, {sql_dummies("CREDIT_ACTIVE", ["Active", "Closed", "Sold"], True)},
        {sql_dummies("CREDIT_TYPE", PRIORITIES, True)} FROM {{bureau}}""",
)
def _(t):
    encoded, _names = encode.one_hot(t.bureau.select("SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_TYPE"))
    return _long(encoded, ["SK_ID_BUREAU"])


@query(
    "e2_onehot",
    f"""SELECT SK_ID_BUREAU, {sql_dummies("CREDIT_ACTIVE", ["Active", "Closed", "Sold"], False)},
        {sql_dummies("CREDIT_TYPE", PRIORITIES, False)} FROM {{bureau}}""",
)
def _(t):
    encoded, _names = encode.one_hot(t.bureau.select("SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_TYPE"), missing=False)
    return _long(encoded, ["SK_ID_BUREAU"])


@query(
    "e3_onehot_drop_first",
    f"SELECT SK_ID_BUREAU, CREDIT_ACTIVE, {sql_dummies('CREDIT_TYPE', PRIORITIES[1:], False)} FROM {{bureau}}",
)
def _(t):
    encoded, _names = encode.one_hot(
        t.bureau.select("SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_TYPE"), ["CREDIT_TYPE"], False, drop_first=True
    )
    return _long(encoded, ["SK_ID_BUREAU", "CREDIT_ACTIVE"])


@query(
    "e4_label",
    """WITH codes AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS code
         FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))
       SELECT o_orderkey, code AS o_orderpriority FROM orders JOIN codes ON o_orderpriority = v""",
)
def _(t):
    return encode.label_encode(t.table("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query(
    "e5_ordinal",
    """SELECT SK_ID_BUREAU, CAST(CASE CREDIT_ACTIVE WHEN 'Closed' THEN 0 WHEN 'Active' THEN 1 ELSE 2 END AS BIGINT)
       AS CREDIT_TYPE_CODE FROM {bureau}""",
)
def _(t):
    code = ordinal_code("CREDIT_ACTIVE", {"Closed": 0, "Active": 1}, 2)
    return t.bureau.select("SK_ID_BUREAU", code.cast("long").alias("CREDIT_TYPE_CODE"))


_ORDER_SIZE = "CASE WHEN o_orderkey % 151 = 0 THEN 'huge' WHEN o_orderkey % 167 = 0 THEN 'giant' ELSE o_orderpriority END"


@query(
    "e6_rare",
    f"""WITH rows AS (SELECT o_orderkey, {_ORDER_SIZE} AS size, o_orderstatus FROM orders),
        freq AS (SELECT size, count(*) * 1e0 / (SELECT count(*) FROM rows) AS share FROM rows GROUP BY size)
        SELECT o_orderkey, CASE WHEN share < 0.01 THEN '999' ELSE rows.size END AS size, o_orderstatus
        FROM rows JOIN freq ON rows.size = freq.size""",
)
def _(t):
    rows = t.table("orders").select("o_orderkey", F.expr(_ORDER_SIZE).alias("size"), "o_orderstatus")
    return encode.rare_to_other(rows, ["size", "o_orderstatus"], 0.01)


_E7 = ("o_orderstatus", "o_orderpriority", "is_large", "parity")


@query(
    "e7_binary",
    """WITH rows AS (SELECT o_orderstatus, o_orderpriority, CASE WHEN o_totalprice > 250000 THEN 'yes' ELSE 'no' END
         AS is_large, o_orderkey % 2 AS parity FROM orders)
       SELECT c AS "column" FROM (""" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n FROM rows" for c in _E7
    ) + ") u WHERE n = 2",
)
def _(t):
    rows = t.table("orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.when(F.col("o_totalprice") > 250000, "yes").otherwise("no").alias("is_large"),
        (F.col("o_orderkey") % 2).cast("int").alias("parity"),
    )
    names = encode.binary_columns(rows)
    return t.spark.createDataFrame([(n,) for n in names], "column string")


@query(
    "e8_missing_flags",
    """SELECT SK_ID_BUREAU, CAST(CASE WHEN CREDIT_TYPE IS NULL THEN 1 ELSE 0 END AS BIGINT) AS CREDIT_TYPE_NA_FLAG,
       CAST(CASE WHEN AMT_ANNUITY IS NULL THEN 1 ELSE 0 END AS BIGINT) AS AMT_ANNUITY_NA_FLAG FROM {bureau}""",
)
def _(t):
    flagged = encode.missing_flags(t.bureau, ["CREDIT_TYPE", "AMT_ANNUITY"])
    return _long(flagged.select("SK_ID_BUREAU", "CREDIT_TYPE_NA_FLAG", "AMT_ANNUITY_NA_FLAG"), ["SK_ID_BUREAU"])


# --- row-level features -----------------------------------------------------------------------


def sql_div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


APPLICATION_RATIOS = {
    "CREDIT_INCOME_PERCENT": sql_div("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "ANNUITY_INCOME_PERCENT": sql_div("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "CREDIT_ANNUITY_PERCENT": sql_div("AMT_CREDIT", "AMT_ANNUITY"),
    "FAMILY_CNT_INCOME_PERCENT": sql_div("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "CREDIT_TERM": sql_div("AMT_ANNUITY", "AMT_CREDIT"),
    "BIRTH_EMPLOYED_PERCENT": sql_div("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "CHILDREN_CNT_INCOME_PERCENT": sql_div("AMT_INCOME_TOTAL", "CNT_CHILDREN"),
    "CREDIT_GOODS_DIFF": "AMT_CREDIT - AMT_GOODS_PRICE",
    "EMPLOYED_REGISTRATION_PERCENT": sql_div("DAYS_EMPLOYED", "DAYS_REGISTRATION"),
    "BIRTH_REGISTRATION_PERCENT": sql_div("DAYS_BIRTH", "DAYS_REGISTRATION"),
    "ID_REGISTRATION_DIFF": "DAYS_ID_PUBLISH - DAYS_REGISTRATION",
    "ANNUITY_LENGTH_EMPLOYED_PERCENT": sql_div(sql_div("AMT_ANNUITY", "AMT_CREDIT"), "DAYS_EMPLOYED"),
    "AGE_LOAN_FINISH": f"DAYS_BIRTH * (-1e0 / 365) + {sql_div('AMT_CREDIT', 'AMT_ANNUITY')} * (1e0 / 12)",
    "CAR_AGE_EMP_PERCENT": sql_div("OWN_CAR_AGE", "DAYS_EMPLOYED"),
    "CAR_AGE_BIRTH_PERCENT": sql_div("OWN_CAR_AGE", "DAYS_BIRTH"),
    "PHONE_CHANGE_EMP_PERCENT": sql_div("DAYS_LAST_PHONE_CHANGE", "DAYS_EMPLOYED"),
    "PHONE_CHANGE_BIRTH_PERCENT": sql_div("DAYS_LAST_PHONE_CHANGE", "DAYS_BIRTH"),
}


def _named(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


@query(
    "x1_application_ratios",
    sql_rounded(f"SELECT SK_ID_CURR, {_named(APPLICATION_RATIOS)} FROM {{application}}", ["SK_ID_CURR"]),
)
def _(t):
    return rounded(application_ratios(t.application).select("SK_ID_CURR", *APPLICATION_RATIOS), ["SK_ID_CURR"])


MEDIANS = {
    "NAME_CONTRACT_TYPE": "CONTRACT_TYPE", "NAME_TYPE_SUITE": "SUITE_TYPE", "NAME_HOUSING_TYPE": "HOUSING_TYPE",
    "ORGANIZATION_TYPE": "ORG_TYPE", "OCCUPATION_TYPE": "OCCU_TYPE", "NAME_EDUCATION_TYPE": "EDU_TYPE",
}


def sql_median_joins(table: str) -> str:
    """Left joins that attach the median incomes to alias ``a``."""
    return " ".join(
        f"LEFT JOIN (SELECT {c} AS level, median(AMT_INCOME_TOTAL) AS MEDIAN_INCOME_{n} FROM {table} x "
        f"WHERE {c} IS NOT NULL GROUP BY {c}) m_{n} ON a.{c} = m_{n}.level"
        for c, n in MEDIANS.items()
    )


_MEDIAN_COLUMNS = ", ".join(f"MEDIAN_INCOME_{n}" for n in MEDIANS.values())


@query(
    "a6_group_median_map",
    sql_rounded(
        f"SELECT SK_ID_CURR, {_MEDIAN_COLUMNS} FROM {{application}} a {sql_median_joins('{application}')}",
        ["SK_ID_CURR"],
    ),
)
def _(t):
    attached = attach_median_incomes(t.application, fit_application(t.application))
    return rounded(attached.select("SK_ID_CURR", *[f"MEDIAN_INCOME_{n}" for n in MEDIANS.values()]), ["SK_ID_CURR"])


_BUREAU_ROW = {
    "CREDIT_DURATION": "-DAYS_CREDIT + DAYS_CREDIT_ENDDATE",
    "ENDDATE_DIFF": "DAYS_CREDIT_ENDDATE - DAYS_ENDDATE_FACT",
    "UPDATE_DIFF": "DAYS_CREDIT_ENDDATE - DAYS_CREDIT_UPDATE",
    "DEBT_PERCENTAGE": sql_div("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"),
    "DEBT_CREDIT_DIFF": "AMT_CREDIT_SUM - AMT_CREDIT_SUM_DEBT",
    "CREDIT_TO_ANNUITY_RATIO": sql_div("AMT_CREDIT_SUM", "AMT_ANNUITY"),
    "DEBT_TO_ANNUITY_RATIO": sql_div("AMT_CREDIT_SUM_DEBT", "AMT_ANNUITY"),
    "CREDIT_OVERDUE_DIFF": "AMT_CREDIT_SUM - AMT_CREDIT_SUM_OVERDUE",
}


@query(
    "x8_bureau_rows",
    sql_rounded(f"SELECT SK_ID_BUREAU, {_named(_BUREAU_ROW)} FROM {{bureau}}", ["SK_ID_BUREAU"]),
)
def _(t):
    return rounded(bureau_loan_features(t.bureau).select("SK_ID_BUREAU", *_BUREAU_ROW), ["SK_ID_BUREAU"])


PREVIOUS_ROW = {
    "APPLICATION_CREDIT_DIFF": "AMT_APPLICATION - AMT_CREDIT",
    "APPLICATION_CREDIT_RATIO": sql_div("AMT_APPLICATION", "AMT_CREDIT"),
    "CREDIT_TO_ANNUITY_RATIO": sql_div("AMT_CREDIT", "AMT_ANNUITY"),
    "DOWN_PAYMENT_TO_CREDIT": sql_div("AMT_DOWN_PAYMENT", "AMT_CREDIT"),
    "SIMPLE_INTERESTS": sql_div(sql_div("AMT_ANNUITY * CNT_PAYMENT", "AMT_CREDIT") + " - 1", "CNT_PAYMENT"),
    "DAYS_LAST_DUE_DIFF": "DAYS_LAST_DUE_1ST_VERSION - DAYS_LAST_DUE",
}


@query(
    "x11_previous_rows",
    sql_rounded(f"SELECT SK_ID_PREV, {_named(PREVIOUS_ROW)} FROM {sql_clean_previous()} p", ["SK_ID_PREV"]),
)
def _(t):
    rows = previous_loan_features(clean_previous(t.previous))
    return rounded(rows.select("SK_ID_PREV", *PREVIOUS_ROW), ["SK_ID_PREV"])


@query(
    "x14_late_flag",
    """SELECT SK_ID_PREV, TIE_LINE, TIE_PART, TIE_SUPPLIER,
       CAST(CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END AS BIGINT) AS LATE_PAYMENT FROM {pos}""",
)
def _(t):
    return pos_row_features(t.pos).select(
        "SK_ID_PREV", "TIE_LINE", "TIE_PART", "TIE_SUPPLIER", F.col("LATE_PAYMENT").cast("long")
    )


def sql_clip(d: str) -> str:
    return f"CASE WHEN {d} <= 0 THEN 0 ELSE {d} END"


SQL_INSTALMENT_ROWS = f"""(SELECT *, AMT_INSTALMENT - AMT_PAYMENT_GROUPED AS PAYMENT_DIFFERENCE,
    {sql_div("AMT_INSTALMENT", "AMT_PAYMENT_GROUPED")} AS PAYMENT_RATIO,
    CASE WHEN LATE_PAYMENT = 1 THEN INSTALMENT_PAYMENT_RATIO ELSE 0 END AS LATE_PAYMENT_RATIO,
    CASE WHEN LATE_PAYMENT = 1 AND INSTALMENT_PAYMENT_RATIO > 0.05 THEN 1 ELSE 0 END AS SIGNIFICANT_LATE_PAYMENT,
    {", ".join(f"CASE WHEN DPD >= {d} THEN 1 ELSE 0 END AS DPD_{n}" for n, d in
        [("7", 7), ("15", 15), ("30", 30), ("60", 60), ("90", 90), ("180", 180), ("WOF", 720)])}
    FROM (SELECT *, CASE WHEN DBD > 0 THEN 1 ELSE 0 END AS LATE_PAYMENT FROM (
      SELECT *, coalesce(sum(AMT_PAYMENT) OVER (PARTITION BY SK_ID_PREV, NUM_INSTALMENT_NUMBER), 0) AS AMT_PAYMENT_GROUPED,
        AMT_PAYMENT - AMT_INSTALMENT AS PAID_OVER_AMOUNT,
        CASE WHEN AMT_PAYMENT - AMT_INSTALMENT > 0 THEN 1 ELSE 0 END AS PAID_OVER,
        {sql_clip("DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT")} AS DPD,
        {sql_clip("DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT")} AS DBD,
        {sql_div("AMT_PAYMENT", "AMT_INSTALMENT")} AS INSTALMENT_PAYMENT_RATIO
      FROM {{source}}) a) b)"""

_INST_ROW = (
    "AMT_PAYMENT_GROUPED", "PAYMENT_DIFFERENCE", "PAYMENT_RATIO", "PAID_OVER_AMOUNT", "PAID_OVER", "DPD", "DBD",
    "LATE_PAYMENT", "INSTALMENT_PAYMENT_RATIO", "LATE_PAYMENT_RATIO", "SIGNIFICANT_LATE_PAYMENT",
    "DPD_7", "DPD_15", "DPD_30", "DPD_60", "DPD_90", "DPD_180", "DPD_WOF",
)
_INST_KEYS = ["SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "AMT_INSTALMENT"]


@query(
    "x15_instalment_rows",
    sql_rounded(
        f"SELECT {', '.join(_INST_KEYS)}, {', '.join(_INST_ROW)} FROM "
        + SQL_INSTALMENT_ROWS.replace("{source}", "{instalments}") + " r",
        _INST_KEYS,
    ),
)
def _(t):
    return rounded(instalment_row_features(t.instalments).select(*_INST_KEYS, *_INST_ROW), _INST_KEYS)


_ZEROED = [
    "SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT",
    "CASE WHEN SK_ID_PREV % 3 = 0 THEN 0e0 ELSE AMT_INSTALMENT END AS AMT_INSTALMENT",
    "CASE WHEN SK_ID_PREV % 6 = 0 THEN 0e0 ELSE AMT_PAYMENT END AS AMT_PAYMENT",
]


@query(
    "x15_ieee",
    f"""SELECT SK_ID_PREV, NUM_INSTALMENT_NUMBER, AMT_INSTALMENT,
        CASE WHEN AMT_INSTALMENT = 0 AND AMT_PAYMENT > 0 THEN 'inf' WHEN AMT_INSTALMENT <> 0 AND AMT_PAYMENT IS NOT NULL THEN 'finite' END AS ratio,
        CASE WHEN DAYS_INSTALMENT > DAYS_ENTRY_PAYMENT AND ((AMT_INSTALMENT = 0 AND AMT_PAYMENT > 0)
             OR (AMT_INSTALMENT <> 0 AND AMT_PAYMENT / AMT_INSTALMENT > 0.05e0)) THEN 1 ELSE 0 END AS significant
        FROM (SELECT {", ".join(_ZEROED)} FROM {{instalments}}) z""",
)
def _(t):
    rows = late_columns(t.instalments.selectExpr(*_ZEROED), mode="ieee")
    ratio = F.col("INSTALMENT_PAYMENT_RATIO")
    kind = F.when(ratio == float("inf"), "inf").when(ratio.isNotNull(), "finite")
    return rows.select(
        *_INST_KEYS, kind.alias("ratio"), F.col("SIGNIFICANT_LATE_PAYMENT").alias("significant")
    )


CARD_ROW = {
    "LIMIT_USE": sql_div("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"),
    "PAYMENT_DIV_MIN": sql_div("AMT_PAYMENT_CURRENT", "AMT_INST_MIN_REGULARITY"),
    "LATE_PAYMENT": "CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END",
    "DRAWING_LIMIT_RATIO": sql_div("AMT_DRAWINGS_ATM_CURRENT", "AMT_CREDIT_LIMIT_ACTUAL"),
}
_CARD_KEYS = ["SK_ID_PREV", "MONTHS_BALANCE", "AMT_RECEIVABLE"]


@query(
    "x20_card_rows",
    sql_rounded(
        f"SELECT SK_ID_PREV, CAST(MONTHS_BALANCE AS BIGINT) AS MONTHS_BALANCE, AMT_RECIVABLE AS AMT_RECEIVABLE, "
        f"{_named(CARD_ROW)} FROM {{card}}",
        _CARD_KEYS,
    ),
)
def _(t):
    rows = card_row_features(t.card).withColumn("MONTHS_BALANCE", F.col("MONTHS_BALANCE").cast("long"))
    return rounded(rows.select(*_CARD_KEYS, *CARD_ROW), _CARD_KEYS)
