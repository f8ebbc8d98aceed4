"""Grouped aggregation, attached statistics and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.catalog.registry import query, r4, rounded, sql_r4, sql_rounded
from loanloom.functions import AggSpec, safe_div
from loanloom.operators import profile
from loanloom.operators.attach import attach_stats, join_with_suffix, left_join_blocks
from loanloom.operators.correlation import correlations
from loanloom.operators.quantiles import group_median
from loanloom.plans.bureau import balance_features
from loanloom.plans.instalments import attach_payment_sum
from loanloom.plans.pos import LOAN_FEATURES, loan_outcomes
from loanloom.plans.roles import POS_TIE_BREAK


@query(
    "a1_multi_stat",
    sql_rounded(
        """SELECT o_custkey, min(o_totalprice) AS ORD_PRICE_MIN, max(o_totalprice) AS ORD_PRICE_MAX,
           avg(o_totalprice) AS ORD_PRICE_MEAN, coalesce(sum(o_totalprice), 0) AS ORD_PRICE_SUM,
           var_samp(o_totalprice) AS ORD_PRICE_VAR, count(*) AS ORD_PRICE_SIZE,
           count(o_totalprice) AS ORD_PRICE_COUNT, count(DISTINCT o_orderpriority) AS ORD_PRIORITY_NUNIQUE
           FROM (SELECT o_custkey, floor(o_totalprice) AS o_totalprice, o_orderpriority FROM orders) o
           GROUP BY o_custkey""",
        ["o_custkey"],
    ),
)
def _(t):
    orders = t.table("orders").withColumn("o_totalprice", F.floor("o_totalprice").cast("double"))
    spec = AggSpec(
        {"PRICE": ["min", "max", "mean", "sum", "var", "size", "count"], "PRIORITY": ["nunique"]},
        {"PRICE": "o_totalprice", "PRIORITY": "o_orderpriority"},
    )
    return rounded(orders.groupBy("o_custkey").agg(*spec.columns("ORD_")), ["o_custkey"])


@query(
    "a2_group_counts",
    """SELECT SK_ID_CURR, CAST(count(CREDIT_TYPE) AS BIGINT) AS n_typed, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT CREDIT_TYPE) AS BIGINT) AS n_types FROM {bureau} GROUP BY SK_ID_CURR""",
)
def _(t):
    spec = AggSpec(
        {"typed": ["count"], "rows": ["size"], "types": ["nunique"]},
        {"typed": "CREDIT_TYPE", "types": "CREDIT_TYPE"},
    )
    grouped = t.bureau.groupBy("SK_ID_CURR").agg(*spec.columns())
    return grouped.toDF("SK_ID_CURR", "n_typed", "n_rows", "n_types")


@query(
    "a5_group_sum_mean",
    sql_rounded(
        """SELECT SK_ID_CURR, coalesce(sum(AMT_CREDIT_SUM_LIMIT), 0) AS LIMIT_SUM, avg(AMT_CREDIT_SUM_LIMIT) AS LIMIT_MEAN
           FROM {bureau} GROUP BY SK_ID_CURR""",
        ["SK_ID_CURR"],
    ),
)
def _(t):
    spec = AggSpec({"LIMIT": ["sum", "mean"]}, {"LIMIT": "AMT_CREDIT_SUM_LIMIT"})
    return rounded(t.bureau.groupBy("SK_ID_CURR").agg(*spec.columns()), ["SK_ID_CURR"])


@query(
    "a6_group_median",
    f"""SELECT l_returnflag, l_linestatus, {sql_r4("median(l_extendedprice)")} AS median
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def _(t):
    medians = group_median(t.table("lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return medians.withColumn("median", r4("median"))


@query(
    "a8_all_columns",
    sql_rounded(
        "SELECT l_returnflag, " + ", ".join(
            f"max({c}) AS {c}_MAX, avg({c}) AS {c}_MEAN, coalesce(sum({c}), 0) AS {c}_SUM, var_samp({c}) AS {c}_VAR"
            for c in ("l_linenumber", "l_quantity", "l_partkey")
        ) + " FROM lineitem GROUP BY l_returnflag",
        ["l_returnflag"],
    ),
)
def _(t):
    rows = t.table("lineitem").select("l_returnflag", "l_linenumber", "l_quantity", "l_partkey")
    spec = AggSpec.every([c for c in rows.columns if c != "l_returnflag"], ["max", "mean", "sum", "var"])
    return rounded(rows.groupBy("l_returnflag").agg(*spec.columns()), ["l_returnflag"])


def sql_edge(column: str, side: str) -> str:
    """First or last known value in the balance order."""
    order = "(MONTHS_BALANCE, TIE_LINE, TIE_PART, TIE_SUPPLIER)"
    pick = "arg_min" if side == "first" else "arg_max"
    return f"{pick}({column}, {order}) FILTER (WHERE {column} IS NOT NULL)"


@query(
    "a9_first_last",
    sql_rounded(
        f"""SELECT SK_ID_PREV, {sql_edge("CNT_INSTALMENT", "first")} AS first_plan,
            {sql_edge("CNT_INSTALMENT", "last")} AS last_plan,
            {sql_edge("CNT_INSTALMENT_FUTURE", "last")} AS remaining FROM {{pos}} GROUP BY SK_ID_PREV""",
        ["SK_ID_PREV"],
    ),
)
def _(t):
    order = F.struct("MONTHS_BALANCE", *POS_TIE_BREAK)

    def edge(pick, c):
        return pick(F.when(F.col(c).isNotNull(), F.struct(order, F.col(c).alias("v"))))["v"]

    firsts = t.pos.groupBy("SK_ID_PREV").agg(
        edge(F.min, "CNT_INSTALMENT").alias("first_plan"),
        edge(F.max, "CNT_INSTALMENT").alias("last_plan"),
        edge(F.max, "CNT_INSTALMENT_FUTURE").alias("remaining"),
    )
    return rounded(firsts, ["SK_ID_PREV"])


def sql_loans(source: str) -> str:
    """Loan outcomes of a set of balance rows."""
    first, last = sql_edge("CNT_INSTALMENT", "first"), sql_edge("CNT_INSTALMENT", "last")
    left = sql_edge("CNT_INSTALMENT_FUTURE", "last")
    done = "avg(CASE WHEN NAME_CONTRACT_STATUS = 'Completed' THEN 1 ELSE 0 END)"
    return f"""SELECT min(SK_ID_CURR) AS SK_ID_CURR, SK_ID_PREV, {done} AS POS_LOAN_COMPLETED_MEAN,
        CASE WHEN {first} - {last} > 0 AND {done} > 0 THEN 1 ELSE 0 END AS POS_COMPLETED_BEFORE_MEAN,
        {left} AS POS_REMAINING_INSTALMENTS, {left} / nullif({last}, 0) AS POS_REMAINING_INSTALMENTS_RATIO
        FROM {source} GROUP BY SK_ID_PREV"""


@query("a9_loan_outcomes", sql_rounded(f"SELECT * EXCLUDE (SK_ID_CURR) FROM ({sql_loans('{pos}')}) l", ["SK_ID_PREV"]))
def _(t):
    return rounded(loan_outcomes(t.pos, ["SK_ID_PREV"], ["MONTHS_BALANCE", *POS_TIE_BREAK]), ["SK_ID_PREV"])


def sql_loan_sums(source: str) -> str:
    sums = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in LOAN_FEATURES)
    return f"SELECT SK_ID_CURR, {sums} FROM ({sql_loans(source)}) l GROUP BY SK_ID_CURR"


@query("a10_two_level", sql_rounded(sql_loan_sums("{pos}"), ["SK_ID_CURR"]))
def _(t):
    loans = loan_outcomes(t.pos, ["SK_ID_CURR", "SK_ID_PREV"], ["MONTHS_BALANCE", *POS_TIE_BREAK])
    sums = loans.groupBy("SK_ID_CURR").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LOAN_FEATURES])
    return rounded(sums, ["SK_ID_CURR"])


@query(
    "a23_global_stats",
    sql_rounded(
        """SELECT 'orders' AS name, min(o_totalprice) AS price_min, max(o_totalprice) AS price_max,
           avg(o_custkey) AS cust_mean, count(DISTINCT o_custkey) AS cust_nunique,
           count(*) FILTER (WHERE p IS NULL) AS n_missing
           FROM (SELECT *, nullif(o_orderpriority, '4-NOT SPECIFIED') AS p FROM orders) o""",
        ["name"],
    ),
)
def _(t):
    orders = t.table("orders").withColumn("p", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))
    stats = orders.agg(
        F.min("o_totalprice").alias("price_min"),
        F.max("o_totalprice").alias("price_max"),
        F.avg("o_custkey").alias("cust_mean"),
        F.count_distinct("o_custkey").alias("cust_nunique"),
        F.count_if(F.col("p").isNull()).alias("n_missing"),
    )
    return rounded(stats.select(F.lit("orders").alias("name"), "*"), ["name"])


@query(
    "a24_crosstab",
    f"""SELECT NAME_CONTRACT_TYPE, {sql_r4("100e0 * count(*) FILTER (WHERE TARGET = 0) / count(*)")} AS percent_0,
        {sql_r4("100e0 * count(*) FILTER (WHERE TARGET = 1) / count(*)")} AS percent_1
        FROM {{application}} GROUP BY NAME_CONTRACT_TYPE""",
)
def _(t):
    return rounded(profile.target_percent(t.application, "NAME_CONTRACT_TYPE", "TARGET"), ["NAME_CONTRACT_TYPE"])


CORRELATED = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_EMPLOYED", "OWN_CAR_AGE", "EXT_SOURCE_1"]


def sql_correlations(columns: list[str], source: str) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM {source} x" for a, b in pairs
    )


@query("a25_corr", sql_rounded(sql_correlations(CORRELATED, "{application}"), ["col_a", "col_b"]))
def _(t):
    return rounded(correlations(t.application, CORRELATED), ["col_a", "col_b"])


# Thirty columns: multiples of a few, one constant where its partner is known, and one with NaN.
_WIDE = {f"w{i}": f"CAST(AMT_CREDIT + {i} * AMT_ANNUITY * (CNT_CHILDREN % 2) AS DOUBLE)" for i in range(27)} | {
    "half": "CASE WHEN SK_ID_CURR % 2 = 0 THEN 0.1e0 WHEN SK_ID_CURR % 3 = 0 THEN CAST(DAYS_BIRTH AS DOUBLE) END",
    "other_half": "CASE WHEN SK_ID_CURR % 2 = 0 THEN CAST(DAYS_BIRTH AS DOUBLE) END",
    "with_nan": "CASE WHEN SK_ID_CURR % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(DAYS_BIRTH AS DOUBLE) END",
}
_WIDE_ROWS = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in _WIDE.items()) + " FROM {application})"
_WIDE_SQL = f"SELECT {', '.join(n if n != 'with_nan' else 'CASE WHEN NOT isnan(with_nan) THEN with_nan END AS with_nan' for n in _WIDE)} FROM {_WIDE_ROWS} w"


@query("a25_wide", sql_rounded(
    f"SELECT col_a, col_b, CASE WHEN NOT isnan(r) THEN r END AS r FROM ({sql_correlations(list(_WIDE), f'({_WIDE_SQL})')}) c",
    ["col_a", "col_b"],
))
def _(t):
    rows = t.application.select(*[F.expr(e).alias(n) for n, e in _WIDE.items()])
    return rounded(correlations(rows), ["col_a", "col_b"])


@query("a25_corr_moments", sql_rounded(sql_correlations(CORRELATED, "{application}"), ["col_a", "col_b"]))
def _(t):
    return rounded(correlations(t.application.repartition(7), CORRELATED), ["col_a", "col_b"])


# --- joins ------------------------------------------------------------------------------------

_J1_SQL = """SELECT SK_ID_BUREAU, n AS CUSTOMER_LOAN_COUNT, total AS TOTAL_CREDIT_SUM FROM {bureau}
    LEFT JOIN (SELECT SK_ID_CURR AS k, count(SK_ID_BUREAU) AS n, coalesce(sum(AMT_CREDIT_SUM), 0) AS total
      FROM {bureau} GROUP BY SK_ID_CURR) g ON SK_ID_CURR = k"""


@query("j1_attach_group_stats", sql_rounded(_J1_SQL, ["SK_ID_BUREAU"]))
def _(t):
    attached = attach_stats(
        t.bureau,
        "SK_ID_CURR",
        {
            "CUSTOMER_LOAN_COUNT": F.count("SK_ID_BUREAU"),
            "TOTAL_CREDIT_SUM": F.coalesce(F.sum("AMT_CREDIT_SUM"), F.lit(0)),
        },
    )
    return rounded(attached.select("SK_ID_BUREAU", "CUSTOMER_LOAN_COUNT", "TOTAL_CREDIT_SUM"), ["SK_ID_BUREAU"])


@query(
    "j2_attach_payment_sum",
    sql_rounded(
        """SELECT SK_ID_PREV, NUM_INSTALMENT_NUMBER, AMT_PAYMENT,
           coalesce(sum(AMT_PAYMENT) OVER (PARTITION BY SK_ID_PREV, NUM_INSTALMENT_NUMBER), 0) AS AMT_PAYMENT_GROUPED
           FROM {instalments}""",
        ["SK_ID_PREV", "NUM_INSTALMENT_NUMBER"],
    ),
)
def _(t):
    rows = attach_payment_sum(t.instalments)
    keys = ["SK_ID_PREV", "NUM_INSTALMENT_NUMBER"]
    return rounded(rows.select(*keys, "AMT_PAYMENT", "AMT_PAYMENT_GROUPED"), keys)


@query(
    "j3_child_to_parent",
    """SELECT SK_ID_BUREAU, SK_ID_CURR, CAST(n AS BIGINT) AS MONTHS_BALANCE_SIZE FROM {bureau}
       LEFT JOIN (SELECT SK_ID_BUREAU AS k, count(*) AS n FROM {bureau_balance} GROUP BY SK_ID_BUREAU) b
       ON SK_ID_BUREAU = k""",
)
def _(t):
    balance = balance_features(t.bureau_balance).select("SK_ID_BUREAU", "MONTHS_BALANCE_SIZE")
    return left_join_blocks(t.bureau.select("SK_ID_BUREAU", "SK_ID_CURR"), [balance], "SK_ID_BUREAU")


@query(
    "j4_segment_siblings",
    sql_rounded(
        """SELECT a.SK_ID_CURR, n_all, active_sum, closed_sum FROM
           (SELECT SK_ID_CURR, count(*) AS n_all FROM {bureau} GROUP BY SK_ID_CURR) a
           LEFT JOIN (SELECT SK_ID_CURR, coalesce(sum(AMT_CREDIT_SUM), 0) AS active_sum FROM {bureau}
             WHERE CREDIT_ACTIVE = 'Active' GROUP BY SK_ID_CURR) s ON a.SK_ID_CURR = s.SK_ID_CURR
           LEFT JOIN (SELECT SK_ID_CURR, coalesce(sum(AMT_CREDIT_SUM), 0) AS closed_sum FROM {bureau}
             WHERE CREDIT_ACTIVE = 'Closed' GROUP BY SK_ID_CURR) c ON a.SK_ID_CURR = c.SK_ID_CURR""",
        ["SK_ID_CURR"],
    ),
)
def _(t):
    spec = AggSpec({"AMT_CREDIT_SUM": ["sum"]})
    active, closed = (f"CREDIT_ACTIVE = '{s}'" for s in ("Active", "Closed"))
    grouped = t.bureau.groupBy("SK_ID_CURR").agg(
        F.count(F.lit(1)), *spec.columns("A_", where=active), *spec.columns("C_", where=closed)
    )
    return rounded(grouped.toDF("SK_ID_CURR", "n_all", "active_sum", "closed_sum"), ["SK_ID_CURR"])


@query(
    "j5_attach_block",
    sql_rounded(
        """SELECT a.SK_ID_CURR, credit_count, balance_max FROM {application} a LEFT JOIN
           (SELECT SK_ID_CURR AS k, count(*) AS credit_count, max(AMT_BALANCE) AS balance_max
            FROM {card} GROUP BY SK_ID_CURR) c ON a.SK_ID_CURR = k""",
        ["SK_ID_CURR"],
    ),
)
def _(t):
    block = t.card.groupBy("SK_ID_CURR").agg(
        F.count(F.lit(1)).alias("credit_count"), F.max("AMT_BALANCE").alias("balance_max")
    )
    return rounded(left_join_blocks(t.application.select("SK_ID_CURR"), [block], "SK_ID_CURR"), ["SK_ID_CURR"])


@query(
    "j6_suffix_join",
    sql_rounded(
        """SELECT a.SK_ID_CURR, a.n AS n, b.n AS n_year, b.top AS top FROM
           (SELECT SK_ID_CURR, count(*) AS n FROM {previous} GROUP BY SK_ID_CURR) a LEFT JOIN
           (SELECT SK_ID_CURR, count(*) AS n, max(AMT_APPLICATION) AS top FROM {previous}
            WHERE DAYS_DECISION >= -365 GROUP BY SK_ID_CURR) b ON a.SK_ID_CURR = b.SK_ID_CURR""",
        ["SK_ID_CURR"],
    ),
)
def _(t):
    overall = t.previous.groupBy("SK_ID_CURR").agg(F.count(F.lit(1)).alias("n"))
    year = t.previous.where(F.col("DAYS_DECISION") >= -365).groupBy("SK_ID_CURR").agg(
        F.count(F.lit(1)).alias("n"), F.max("AMT_APPLICATION").alias("top")
    )
    return rounded(join_with_suffix(overall, year, "SK_ID_CURR", "_year"), ["SK_ID_CURR"])


@query(
    "j8_aligned_columns",
    f"""SELECT CREDIT_TYPE AS level, CAST(count(*) AS BIGINT) AS n,
        {sql_r4("count(*) * 1e0 / (SELECT count(*) FROM {bureau})")} AS ratio,
        {sql_r4("avg(AMT_CREDIT_SUM)")} AS credit_mean
        FROM {{bureau}} WHERE CREDIT_TYPE IS NOT NULL GROUP BY CREDIT_TYPE""",
)
def _(t):
    total = t.bureau.agg(F.count(F.lit(1))).scalar()
    levels = t.bureau.where(F.col("CREDIT_TYPE").isNotNull()).groupBy(F.col("CREDIT_TYPE").alias("level"))
    aligned = levels.agg(F.count(F.lit(1)).alias("n"), F.avg("AMT_CREDIT_SUM").alias("credit_mean"))
    return aligned.select(
        "level", "n", r4(safe_div("n", total)).alias("ratio"), r4("credit_mean").alias("credit_mean")
    )
