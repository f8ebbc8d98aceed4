"""Feature blocks per source, look-back slices and the applicant matrix.

The SQL twins follow the textbook shape (filter, aggregate and left join per
slice and segment), which the Spark plans avoid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from loanloom.catalog.aggregates import sql_loan_sums
from loanloom.catalog.cleaning import (
    APPLICATION_RATIOS,
    CARD_ROW,
    MEDIANS,
    PREVIOUS_ROW,
    PRIORITIES,
    SQL_INSTALMENT_ROWS,
    sql_clean_application,
    sql_clean_previous,
    sql_div,
    sql_dummies,
    sql_median_joins,
)
from loanloom.catalog.registry import query, rounded, sql_rounded
from loanloom.functions import AggSpec, clean_name
from loanloom.operators.recency import Block, recency_features
from loanloom.plans import bureau, card, instalments, matrix, pos, previous
from loanloom.plans.application import application_features, clean_and_fit
from loanloom.plans.roles import CARD_SLICES, POS_TIE_BREAK
from loanloom.sources import shared_dir

KEY = ["SK_ID_CURR"]

# --- SQL pieces: a block is {feature: aggregate} over a row source -----------------------------

_SQL_STAT = {
    "min": "min({x})", "max": "max({x})", "mean": "avg({x})", "sum": "coalesce(sum({x}), 0)",
    "var": "var_samp({x})", "size": "count(*)", "nunique": "count(DISTINCT {x})",
}
Features = dict[str, str]


def _stats(spec: dict[str, str], prefix: str, upper: bool = True) -> Features:
    return {
        f"{prefix}{c}_{s.upper() if upper else s}": _SQL_STAT[s].format(x=c)
        for c, stats in spec.items()
        for s in stats.split()
    }


def _dummies(column: str, values: list[str], missing: bool = True) -> Features:
    found = {
        clean_name(f"{column}_{v}"): f"(CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END)" for v in values
    }
    if missing:
        found[f"{column}_nan"] = f"(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END)"
    return found


def _dummy_stats(dummies: Features, stats: str, prefix: str, upper: bool = True) -> Features:
    return {
        f"{prefix}{n}_{s.upper() if upper else s}": _SQL_STAT[s].format(x=e)
        for n, e in dummies.items()
        for s in stats.split()
    }


def _grouped(features: Features, rows: str, where: str = "TRUE", key: str = "SK_ID_CURR") -> str:
    body = ", ".join(f"{e} AS {n}" for n, e in features.items())
    return f"(SELECT {key}, {body} FROM {rows} g WHERE {where} GROUP BY {key})"


def _joined(base: str, parts: list[tuple[str, list[str], str]], key: str = "SK_ID_CURR") -> str:
    """Left joins of ``(statement, features, suffix)`` to the keys of a base."""
    picks = ", ".join(f"p{i}.{n} AS {n}{s}" for i, (_, names, s) in enumerate(parts) for n in names)
    joins = " ".join(f"LEFT JOIN {sql} p{i} ON b.{key} = p{i}.{key}" for i, (sql, _, _) in enumerate(parts))
    return f"(SELECT b.{key}, {picks} FROM {base} b {joins})"


def _keys(rows: str) -> str:
    return f"(SELECT DISTINCT SK_ID_CURR FROM {rows} k WHERE SK_ID_CURR IS NOT NULL)"


SqlBlock = Callable[[str], tuple[str, list[str]]]


def _sliced(block: SqlBlock, rows: str, offset: str, slices: dict[str, int | None]) -> str:
    parts = []
    for suffix, bound in slices.items():
        part = rows if bound is None else f"(SELECT * FROM {rows} q WHERE {offset} >= -{bound})"
        sql, names = block(part)
        parts.append((sql, names, suffix))
    return _joined(_keys(rows), parts)


DAYS = {"": None, "_year": 365, "_half_year": 182, "_quarter": 90, "_month": 30, "_fortnight": 14, "_week": 7}
MONTHS = {"": None, "_year": 12, "_half_year": 6, "_quarter": 3, "_month": 1}

# --- bureau -----------------------------------------------------------------------------------

_RETURN_FLAGS = ["A", "N", "R"]
_BALANCE_DUMMIES = _dummies("STATUS", _RETURN_FLAGS)


@query(
    "a11_balance_block",
    sql_rounded(
        "SELECT * FROM " + _grouped(
            _stats({"MONTHS_BALANCE": "min max mean size"}, "")
            | _dummy_stats(_BALANCE_DUMMIES, "min max mean size", ""),
            "{bureau_balance}", key="SK_ID_BUREAU",
        ),
        ["SK_ID_BUREAU"],
    ),
)
def _(t):
    return rounded(bureau.balance_features(t.bureau_balance, months=True), ["SK_ID_BUREAU"])


_LOANS = """(SELECT * REPLACE (coalesce(AMT_CREDIT_SUM, 0) AS AMT_CREDIT_SUM,
    coalesce(AMT_CREDIT_SUM_DEBT, 0) AS AMT_CREDIT_SUM_DEBT, coalesce(AMT_ANNUITY, 0) AS AMT_ANNUITY)
    FROM {bureau} o LEFT JOIN """ + _grouped(
    {"MONTHS_BALANCE_SIZE": "count(*)"} | _dummy_stats(_BALANCE_DUMMIES, "mean min max", ""),
    "{bureau_balance}", key="SK_ID_BUREAU",
) + " y USING (SK_ID_BUREAU))"
_LOAN_STATS = {
    "AMT_CREDIT_SUM_DEBT": "mean sum", "AMT_CREDIT_SUM_OVERDUE": "mean sum", "DAYS_CREDIT": "mean var",
    "DAYS_CREDIT_UPDATE": "mean min", "CREDIT_DAY_OVERDUE": "mean min", "DAYS_CREDIT_ENDDATE": "mean",
    "CNT_CREDIT_PROLONG": "sum", "MONTHS_BALANCE_SIZE": "mean sum", "AMT_CREDIT_SUM_LIMIT": "mean sum",
    "AMT_CREDIT_MAX_OVERDUE": "mean max", "AMT_ANNUITY": "max mean sum", "AMT_CREDIT_SUM": "mean sum max",
}
_LOAN_DUMMIES = _dummies("CREDIT_ACTIVE", ["Active", "Closed", "Sold"]) | _dummies("CREDIT_TYPE", PRIORITIES)


def _bureau_sql() -> tuple[str, list[str]]:
    overall = _stats(_LOAN_STATS, "BUREAU_", upper=False) | _dummy_stats(_LOAN_DUMMIES, "max", "BUREAU_", upper=False)
    for n in _BALANCE_DUMMIES:
        overall |= {
            f"BUREAU_{n}_MEAN_mean": f"avg({n}_MEAN)", f"BUREAU_{n}_MIN_min": f"min({n}_MIN)",
            f"BUREAU_{n}_MAX_max": f"max({n}_MAX)",
        }
    parts = [(_grouped(overall, _LOANS), list(overall), "")]
    for prefix, state in (("A_", "Active"), ("C_", "Closed")):
        segment = _stats(_LOAN_STATS, prefix)
        parts.append((_grouped(segment, _LOANS, f"CREDIT_ACTIVE = '{state}'"), list(segment), ""))
    return _joined(_keys("{bureau}"), parts), [n for _, names, _ in parts for n in names]


@query("f3_bureau", sql_rounded(f"SELECT * FROM {_bureau_sql()[0]} f", KEY))
def _(t):
    return rounded(bureau.bureau_features(t.bureau, t.bureau_balance), KEY)


_CUSTOMER = """(SELECT SK_ID_CURR, count(SK_ID_BUREAU) AS CUSTOMER_LOAN_COUNT,
    count(DISTINCT CREDIT_TYPE) AS CUSTOMER_CREDIT_TYPES,
    avg(CASE CREDIT_ACTIVE WHEN 'Closed' THEN 0 WHEN 'Active' THEN 1 ELSE 2 END) AS CUSTOMER_CREDIT_CODE_MEAN,
    coalesce(sum(AMT_CREDIT_SUM), 0) AS TOTAL_CREDIT_SUM, coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) AS TOTAL_DEBT_SUM
    FROM {bureau} g GROUP BY SK_ID_CURR)"""
_F2 = (
    "CREDIT_TYPE_CODE", "CUSTOMER_LOAN_COUNT", "CUSTOMER_CREDIT_TYPES", "AVG_LOAN_TYPE",
    "CUSTOMER_CREDIT_CODE_MEAN", "TOTAL_CREDIT_SUM", "TOTAL_DEBT_SUM", "CREDIT_DEBT_RATIO", "DEBT_PERCENTAGE",
    "AMT_CREDIT_SUM_DEBT",
)


@query(
    "f2_bureau_customer",
    sql_rounded(
        f"""SELECT SK_ID_BUREAU, CASE CREDIT_ACTIVE WHEN 'Closed' THEN 0 WHEN 'Active' THEN 1 ELSE 2 END AS CREDIT_TYPE_CODE,
        CUSTOMER_LOAN_COUNT, CUSTOMER_CREDIT_TYPES, {sql_div("CUSTOMER_LOAN_COUNT", "CUSTOMER_CREDIT_TYPES")} AS AVG_LOAN_TYPE,
        CUSTOMER_CREDIT_CODE_MEAN, TOTAL_CREDIT_SUM, TOTAL_DEBT_SUM,
        {sql_div("TOTAL_CREDIT_SUM", "TOTAL_DEBT_SUM")} AS CREDIT_DEBT_RATIO,
        {sql_div("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT")} AS DEBT_PERCENTAGE,
        coalesce(AMT_CREDIT_SUM_DEBT, 0) AS AMT_CREDIT_SUM_DEBT
        FROM {{bureau}} b LEFT JOIN {_CUSTOMER} c USING (SK_ID_CURR)""",
        ["SK_ID_BUREAU"],
    ),
)
def _(t):
    return rounded(bureau.bureau_customer_features(t.bureau).select("SK_ID_BUREAU", *_F2), ["SK_ID_BUREAU"])


# --- previous applications --------------------------------------------------------------------

_PREVIOUS_STATS = {
    "AMT_ANNUITY": "max mean", "AMT_APPLICATION": "max mean", "AMT_CREDIT": "max mean", "AMT_DOWN_PAYMENT": "max mean",
    "AMT_GOODS_PRICE": "mean sum", "HOUR_APPR_PROCESS_START": "max mean", "RATE_DOWN_PAYMENT": "max mean",
    "RATE_INTEREST_PRIMARY": "max mean", "RATE_INTEREST_PRIVILEGED": "max mean", "DAYS_DECISION": "max mean",
    "CNT_PAYMENT": "mean sum", "DAYS_FIRST_DRAWING": "max mean", "DAYS_TERMINATION": "max mean",
    "APPLICATION_CREDIT_RATIO": "max mean", "DOWN_PAYMENT_TO_CREDIT": "max mean", "DAYS_LAST_DUE_DIFF": "max mean",
}
_PREVIOUS_DUMMIES = _dummies("NAME_CONTRACT_STATUS", ["Approved", "Canceled", "Refused"]) | _dummies(
    "NAME_PAYMENT_TYPE", PRIORITIES
)
_PREVIOUS_ROWS = (
    "(SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in PREVIOUS_ROW.items()) + f" FROM {sql_clean_previous()} c)"
)


def _previous_block(rows: str) -> tuple[str, list[str]]:
    overall = _stats(_PREVIOUS_STATS, "PREV_") | _dummy_stats(_PREVIOUS_DUMMIES, "mean", "PREV_")
    parts = [(_grouped(overall, rows), list(overall), "")]
    for prefix, status in (("CS_APP_", "Approved"), ("CS_REF_", "Refused")):
        segment = _stats(_PREVIOUS_STATS, prefix)
        parts.append((_grouped(segment, rows, f"NAME_CONTRACT_STATUS = '{status}'"), list(segment), ""))
    return _joined(_keys(rows), parts), [n for _, names, _ in parts for n in names]


@query("f4_previous", sql_rounded(f"SELECT * FROM {_previous_block(_PREVIOUS_ROWS)[0]} f", KEY))
def _(t):
    facts = previous.fit_previous(t.previous)
    return rounded(previous.previous_features(previous.clean_previous(t.previous, facts), fit=facts), KEY)


_W1 = _sliced(_previous_block, "previous_rows", "DAYS_DECISION", DAYS)


@query("w1_previous", "WITH previous_rows AS MATERIALIZED " + _PREVIOUS_ROWS + sql_rounded(f"SELECT * FROM {_W1} f", KEY))
def _(t):
    facts = previous.fit_previous(t.previous)
    return rounded(previous.previous_recency(previous.clean_previous(t.previous, facts), fit=facts), KEY)


# --- point of sale ----------------------------------------------------------------------------

_POS_STATS = {
    "SK_DPD_DEF": "max mean min", "SK_DPD": "max mean min", "MONTHS_BALANCE": "max mean size",
    "CNT_INSTALMENT": "max size", "CNT_INSTALMENT_FUTURE": "max size sum",
}
_POS_DUMMIES = _dummies("NAME_CONTRACT_STATUS", ["Active", "Completed"])


def _pos_block(rows: str) -> tuple[str, list[str]]:
    overall = _stats(_POS_STATS, "POS_") | _dummy_stats(_POS_DUMMIES, "mean", "POS_")
    loans = f"({sql_loan_sums(rows)})"
    parts = [(_grouped(overall, rows), list(overall), ""), (loans, list(pos.LOAN_FEATURES), "")]
    return _joined(_keys(rows), parts), [n for _, names, _ in parts for n in names]


@query("f5_pos", "WITH pos_rows AS MATERIALIZED (SELECT * FROM {pos}) "
       + sql_rounded(f"SELECT * FROM {_pos_block('pos_rows')[0]} f", KEY))
def _(t):
    return rounded(pos.pos_features(t.pos, POS_TIE_BREAK), KEY)


_W2 = _sliced(_pos_block, "pos_rows", "MONTHS_BALANCE", MONTHS)


@query("w2_pos", "WITH pos_rows AS MATERIALIZED (SELECT * FROM {pos}) " + sql_rounded(f"SELECT * FROM {_W2} f", KEY))
def _(t):
    return rounded(pos.pos_recency(t.pos, tie_break=POS_TIE_BREAK), KEY)


# --- instalments ------------------------------------------------------------------------------

_INSTALMENT_STATS = {
    "LATE_PAYMENT": "max mean min", "AMT_PAYMENT": "min max mean sum", "NUM_INSTALMENT_VERSION": "nunique",
    "NUM_INSTALMENT_NUMBER": "max", "AMT_INSTALMENT": "max mean sum", "PAYMENT_DIFFERENCE": "max mean min sum",
    "DAYS_ENTRY_PAYMENT": "max mean sum", "PAID_OVER_AMOUNT": "max mean min",
}


def _instalment_block(rows: str) -> tuple[str, list[str]]:
    features = _stats(_INSTALMENT_STATS, "INS_") | {"INSTALLATION_COUNT": "count(*)"}
    return _grouped(features, SQL_INSTALMENT_ROWS.replace("{source}", rows + " src")), list(features)


@query("f6_instalments", "WITH inst_rows AS MATERIALIZED (SELECT * FROM {instalments}) "
       + sql_rounded(f"SELECT * FROM {_instalment_block('inst_rows')[0]} f", KEY))
def _(t):
    return rounded(instalments.instalment_features(t.instalments), KEY)


_FILLED_INSTALMENTS = """(SELECT * REPLACE (coalesce(DAYS_ENTRY_PAYMENT, 0) AS DAYS_ENTRY_PAYMENT,
    coalesce(AMT_PAYMENT, 0) AS AMT_PAYMENT) FROM {instalments})"""
_W3 = _sliced(_instalment_block, "inst_rows", "DAYS_INSTALMENT", DAYS)


@query("w3_instalments", f"WITH inst_rows AS MATERIALIZED {_FILLED_INSTALMENTS}" + sql_rounded(f"SELECT * FROM {_W3} f", KEY))
def _(t):
    return rounded(instalments.instalment_recency(t.instalments), KEY)


# --- credit card ------------------------------------------------------------------------------

_CARD_COLUMNS = (
    "MONTHS_BALANCE", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_PAYMENT_CURRENT", "AMT_INST_MIN_REGULARITY",
    "AMT_DRAWINGS_ATM_CURRENT", "AMT_RECEIVABLE", "SK_DPD", *CARD_ROW,
)
_CARD_DUMMIES = _dummies("NAME_CONTRACT_STATUS", ["click", "purchase", "signup", "view"])
_CARD_ROWS = (
    "(SELECT * RENAME (AMT_RECIVABLE AS AMT_RECEIVABLE), "
    + ", ".join(f"{e} AS {n}" for n, e in CARD_ROW.items()) + " FROM {card} c)"
)


def _card_block(rows: str) -> tuple[str, list[str]]:
    four = "max mean sum var"
    features = _stats({c: four for c in _CARD_COLUMNS}, "CR_") | _dummy_stats(_CARD_DUMMIES, four, "CR_")
    features["CREDIT_COUNT"] = "count(*)"
    return _grouped(features, rows), list(features)


@query("f7_card", "WITH card_rows AS MATERIALIZED " + _CARD_ROWS
       + sql_rounded(f"SELECT * FROM {_card_block('card_rows')[0]} f", KEY))
def _(t):
    return rounded(card.card_features(t.card), KEY)


_W4 = _sliced(_card_block, "card_rows", "MONTHS_BALANCE", CARD_SLICES)


@query("w4_card", "WITH card_rows AS MATERIALIZED " + _CARD_ROWS + sql_rounded(f"SELECT * FROM {_W4} f", KEY))
def _(t):
    return rounded(card.card_recency(t.card, slices=CARD_SLICES), KEY)


# --- customer order look-back: the narrow, one-pass form ---------------------------------------

_ORDER_SLICES = {"": None, "_year": 365, "_half_year": 182, "_quarter": 90}


def _order_block(rows: str) -> tuple[str, list[str]]:
    features = {"ORD_PRICE_MEAN": "avg(AMT_APPLICATION)", "ORD_PRICE_MAX": "max(AMT_APPLICATION)",
                "ORD_PRICE_SUM": "coalesce(sum(AMT_APPLICATION), 0)", "ORD_COUNT": "count(*)"}
    return _grouped(features, rows), list(features)


def order_lookback(t):
    """Order count and value per customer over all time and the last year, half year and quarter."""
    spec = AggSpec({"PRICE": ["mean", "max", "sum"]}, {"PRICE": "AMT_APPLICATION"})
    block = Block.of(spec, prefix="ORD_", count_as="ORD_COUNT")
    rows = t.previous.select("SK_ID_CURR", "DAYS_DECISION", "AMT_APPLICATION")
    features = recency_features(rows, "SK_ID_CURR", "DAYS_DECISION", _ORDER_SLICES, block, "one_pass")
    return rounded(t.application.select("SK_ID_CURR").join(features, "SK_ID_CURR", "left"), KEY)


_W0_NAMES = [n + s for s in _ORDER_SLICES for n in _order_block("x")[1]]
query(
    "w0_order_lookback",
    sql_rounded(
        "SELECT * FROM " + _joined(
            "{application}",
            [(_sliced(_order_block, "{previous}", "DAYS_DECISION", _ORDER_SLICES), _W0_NAMES, "")],
        ) + " f",
        KEY,
    ),
)(order_lookback)


# --- applicants and the matrix ----------------------------------------------------------------

_LEVELS = {
    "NAME_CONTRACT_TYPE": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "CODE_GENDER": ["F", "M"],
    "NAME_TYPE_SUITE": ["Suite 1", "Suite 2", "Suite 3", "Suite 4", "Unaccompanied"],
    "NAME_FAMILY_STATUS": ["Data_Not_Available", "Married", "Single", "Widow"],
    "NAME_HOUSING_TYPE": ["Data_Not_Available", "House-0", "House-1", "House-2"],
    "NAME_EDUCATION_TYPE": [f"Level {i}" for i in range(3)],
    "OCCUPATION_TYPE": ["Data_Not_Available", *[f"Job/{i}" for i in range(1, 25)]],
    "ORGANIZATION_TYPE": [f"Org {i}" for i in range(10)],
}
_PLAIN = (
    "TARGET", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE",
    "DAYS_BIRTH", "DAYS_EMPLOYED", "DAYS_ID_PUBLISH", "DAYS_REGISTRATION", "DAYS_LAST_PHONE_CHANGE", "OWN_CAR_AGE",
    "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_CONT_MOBILE", "FLAG_EMAIL",
    "FLAG_DOCUMENT_3",
)


def _application_sql(rows: str = "app_rows", fitted_on: str = "app_rows") -> tuple[str, list[str]]:
    features = {c: c for c in _PLAIN} | APPLICATION_RATIOS
    features |= {f"MEDIAN_INCOME_{n}": f"MEDIAN_INCOME_{n}" for n in MEDIANS.values()}
    features |= {
        f"{p}_INCOME_PERCENT": sql_div(f"MEDIAN_INCOME_{p}", "AMT_INCOME_TOTAL")
        for p in ("ORG_TYPE", "OCCU_TYPE", "EDU_TYPE")
    }
    body = ", ".join(f"{e} AS {n}" for n, e in features.items())
    dummies = ", ".join(sql_dummies(c, v, False) for c, v in _LEVELS.items())
    names = [*features, *[clean_name(f"{c}_{v}") for c, values in _LEVELS.items() for v in values]]
    return f"(SELECT SK_ID_CURR, {body}, {dummies} FROM {rows} a {sql_median_joins(fitted_on)})", names


_APP_ROWS = f"app_rows AS MATERIALIZED (SELECT * FROM {sql_clean_application()} c)"
# Two sets of applicants, each cleaned on its own.
_TRAIN = "(SELECT * FROM {application} z WHERE SK_ID_CURR % 11 >= 3)"
_TEST = "(SELECT * FROM {application} z WHERE SK_ID_CURR % 11 < 3)"
_BOTH_APP_ROWS = (
    f"app_rows AS MATERIALIZED (SELECT * FROM {sql_clean_application().replace('{application}', _TRAIN)} c), "
    f"test_rows AS MATERIALIZED (SELECT * FROM {sql_clean_application().replace('{application}', _TEST)} c)"
)


@query("f1_application", f"WITH {_APP_ROWS} " + sql_rounded(f"SELECT * FROM {_application_sql()[0]} f", KEY))
def _(t):
    return rounded(application_features(*clean_and_fit(t.application)), KEY)


def _matrix_sql(app_rows: str, base: str) -> str:
    app, app_names = _application_sql(base)
    blocks = [
        (_bureau_sql()[0], _bureau_sql()[1], {"": None}),
        (_W1, _previous_block("x")[1], DAYS),
        (_W2, _pos_block("x")[1], MONTHS),
        (_W3, _instalment_block("x")[1], DAYS),
        (_W4, _card_block("x")[1], CARD_SLICES),
    ]
    parts = [(app, app_names, "")]
    parts += [(sql, [n + s for s in slices for n in names], "") for sql, names, slices in blocks]
    rows = ", ".join(
        [
            app_rows,
            f"previous_rows AS MATERIALIZED {_PREVIOUS_ROWS}",
            "pos_rows AS MATERIALIZED (SELECT * FROM {pos})",
            f"inst_rows AS MATERIALIZED {_FILLED_INSTALMENTS}",
            f"card_rows AS MATERIALIZED {_CARD_ROWS}",
        ]
    )
    return f"WITH {rows} " + sql_rounded(f"SELECT * FROM {_joined(base, parts)} f", KEY)


def _sources(t) -> matrix.Sources:
    return matrix.Sources(t.bureau, t.bureau_balance, t.previous, t.pos, t.instalments, t.card)


def _blocks(t):
    """Stored blocks; the matrix of new applicants finds those the first one of the same application wrote."""
    blocks = matrix.side_blocks(_sources(t), pos_tie_break=POS_TIE_BREAK, card_slices=CARD_SLICES)
    folder = f"{shared_dir(t.spark)}/{t.spark.sparkContext.applicationId}"
    return matrix.write_blocks(blocks, folder, settings=f"{POS_TIE_BREAK} {CARD_SLICES}")


@query("f8_matrix", _matrix_sql(_APP_ROWS, "app_rows"))
def _(t):
    train, _fit = matrix.train_matrix(t.application, _blocks(t))
    return rounded(train, KEY)


@query("f9_test_matrix", _matrix_sql(_BOTH_APP_ROWS, "test_rows"))
def _(t):
    is_test = F.col("SK_ID_CURR") % 11 < 3
    _train, fit = clean_and_fit(t.application.where(~is_test))
    return rounded(matrix.test_matrix(t.application.where(is_test), _blocks(t), fit), KEY)
