"""Profiles, outliers, duplicates, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.catalog.aggregates import CORRELATED, sql_correlations
from loanloom.catalog.registry import query, r4, rounded, sql_r4, sql_rounded
from loanloom.operators import correlation, duplicates, outliers, profile
from loanloom.operators.encode import sorted_codes

# All columns of the bureau table.
_PROFILED = {
    "SK_ID_BUREAU": "bigint", "SK_ID_CURR": "bigint", "CREDIT_ACTIVE": "string", "CREDIT_TYPE": "string",
    "DAYS_CREDIT": "int", "DAYS_CREDIT_ENDDATE": "double", "DAYS_ENDDATE_FACT": "double", "DAYS_CREDIT_UPDATE": "int",
    "CREDIT_DAY_OVERDUE": "int", "CNT_CREDIT_PROLONG": "int", "AMT_CREDIT_SUM": "double", "AMT_CREDIT_SUM_DEBT": "double",
    "AMT_CREDIT_SUM_LIMIT": "double", "AMT_CREDIT_SUM_OVERDUE": "double", "AMT_CREDIT_MAX_OVERDUE": "double",
    "AMT_ANNUITY": "double",
}
_NUMBERS = [c for c, k in _PROFILED.items() if k != "string"]


def sql_quantiles(column: str, probs: list[float]) -> str:
    return ", ".join(
        f"{sql_r4(f'quantile_cont({column}, {p})')} AS {profile.quantile_name(p)}" for p in probs
    )


def _null_quantiles(probs: list[float]) -> str:
    return ", ".join(f"CAST(NULL AS DOUBLE) AS {profile.quantile_name(p)}" for p in probs)


@query(
    "p1_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{k}' AS dtype, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_miss,
            {sql_quantiles(c, profile.CHECK_PROBS) if k != "string" else _null_quantiles(profile.CHECK_PROBS)}
            FROM {{bureau}}"""
        for c, k in _PROFILED.items()
    ),
)
def _(t):
    return rounded(profile.check_table(t.bureau), ["column", "dtype", "n_miss"])


_TWO = ("CREDIT_ACTIVE", "CREDIT_TYPE")


def _per_level(columns, select: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS level, {select} FROM {{bureau}} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )


@query(
    "p2_cat_summary",
    _per_level(_TWO, f"CAST(count(*) AS BIGINT) AS n, {sql_r4('100e0 * count(*) / (SELECT count(*) FROM {bureau})')} AS ratio"),
)
def _(t):
    return profile.value_counts(t.bureau, _TWO).withColumn("ratio", r4("ratio"))


def sql_describe(columns: list[str], source: str, probs: list[float]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, {sql_r4(f"avg({c})")} AS mean,
            {sql_r4(f"stddev_samp({c})")} AS std, {sql_r4(f"min({c})")} AS min, {sql_r4(f"max({c})")} AS max,
            {sql_quantiles(c, probs)} FROM {source}"""
        for c in columns
    )


@query("p3_num_summary", sql_describe(["DAYS_CREDIT", "AMT_CREDIT_SUM"], "{bureau}", profile.SUMMARY_PROBS))
def _(t):
    return rounded(profile.num_summary(t.bureau, ["DAYS_CREDIT", "AMT_CREDIT_SUM"]), ["column", "count"])


@query("p17_describe", sql_describe(_NUMBERS, "{bureau}", [0.25, 0.5, 0.75]))
def _(t):
    return rounded(profile.describe_numeric(t.bureau), ["column", "count"])


_KINDS = {
    "o_orderkey": False, "o_custkey": False, "o_orderstatus": True, "o_totalprice": False, "o_orderpriority": True,
    "clerk": True, "parity": False,
}
_KIND_ROWS = "(SELECT *, concat('clerk', CAST(o_custkey % 40 AS STRING)) AS clerk, o_orderkey % 2 AS parity FROM orders)"


@query(
    "p4_column_kinds",
    "SELECT c AS \"column\", CASE WHEN is_text AND n > 20 THEN 'cat_but_car' WHEN is_text THEN 'cat' "
    "WHEN n < 10 THEN 'num_but_cat' ELSE 'num' END AS kind FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, {str(text).upper()} AS is_text, count(DISTINCT {c}) AS n FROM {_KIND_ROWS} r"
        for c, text in _KINDS.items()
    ) + ") u",
)
def _(t):
    rows = t.table("orders").withColumns(
        {"clerk": F.expr("concat('clerk', CAST(o_custkey % 40 AS STRING))"), "parity": F.col("o_orderkey") % 2}
    )
    kinds = profile.grab_col_names(rows.select(*_KINDS))
    named = {c: "cat_but_car" for c in kinds.cat_but_car} | {c: "num" for c in kinds.num_cols}
    named |= {c: "cat" for c in kinds.cat_cols} | {c: "num_but_cat" for c in kinds.num_but_cat}
    return t.spark.createDataFrame(sorted(named.items()), "column string, kind string")


@query(
    "p5_target_by_category",
    f"""SELECT NAME_HOUSING_TYPE, {sql_r4("avg(TARGET)")} AS target_mean FROM {{application}}
        WHERE NAME_HOUSING_TYPE IS NOT NULL GROUP BY NAME_HOUSING_TYPE""",
)
def _(t):
    return rounded(profile.target_mean_by_category(t.application, "TARGET", "NAME_HOUSING_TYPE"), ["NAME_HOUSING_TYPE"])


@query(
    "p6_number_by_target",
    f"""SELECT CAST(TARGET AS BIGINT) AS TARGET, {sql_r4("avg(AMT_CREDIT)")} AS AMT_CREDIT_mean,
        {sql_r4("avg(OWN_CAR_AGE)")} AS OWN_CAR_AGE_mean FROM {{application}} GROUP BY TARGET""",
)
def _(t):
    means = profile.numeric_mean_by_target(t.application, "TARGET", ["AMT_CREDIT", "OWN_CAR_AGE"])
    return rounded(means.withColumn("TARGET", F.col("TARGET").cast("long")), ["TARGET"])


_WITH_COPY = [*CORRELATED, "CREDIT_COPY", "INCOME_NEGATED"]
_COPIES = "(SELECT *, AMT_CREDIT * 2 + OWN_CAR_AGE AS CREDIT_COPY, 0 - AMT_INCOME_TOTAL AS INCOME_NEGATED FROM {application})"


def _copies(t):
    return t.application.withColumns(
        {
            "CREDIT_COPY": F.col("AMT_CREDIT") * 2 + F.col("OWN_CAR_AGE"),
            "INCOME_NEGATED": -F.col("AMT_INCOME_TOTAL"),
        }
    )


@query(
    "p7_high_correlated",
    f"SELECT DISTINCT col_b AS \"column\" FROM ({sql_correlations(_WITH_COPY, _COPIES)}) c WHERE abs(r) > 0.9",
)
def _(t):
    names = correlation.high_correlated_columns(_copies(t), _WITH_COPY, 0.9)
    return t.spark.createDataFrame([(n,) for n in names], "column string")


@query(
    "p8_drop_correlated",
    "SELECT SK_ID_CURR, "
    + ", ".join(f"{sql_r4(c)} AS {c}" for c in CORRELATED if c != "AMT_CREDIT")  # follows income
    + " FROM {application}",
)
def _(t):
    kept = correlation.drop_correlated(_copies(t).select("SK_ID_CURR", *_WITH_COPY), _WITH_COPY, 0.9)
    return rounded(kept, ["SK_ID_CURR"])


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_CONSTANT_ROWS = "(SELECT *, 1 AS one, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 'x' END AS x FROM orders)"


@query(
    "p9_constant_columns",
    "SELECT c AS \"column\" FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n FROM {_CONSTANT_ROWS} r" for c in (*_ORDERS, "one", "x")
    ) + ") u WHERE n < 2",
)
def _(t):
    rows = t.table("orders").withColumns({"one": F.lit(1), "x": F.when(F.col("o_orderkey") % 50 != 0, "x")})
    return t.spark.createDataFrame([(n,) for n in profile.constant_columns(rows)], "column string")


@query(
    "p10_near_constants",
    "SELECT \"column\", top_value, n, ratio FROM (" + " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", CAST({c} AS STRING) AS top_value, CAST(count(*) AS BIGINT) AS n,
            {sql_r4("count(*) * 1e0 / (SELECT count(*) FROM {bureau})")} AS ratio
            FROM {{bureau}} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1)"""
        for c in _PROFILED
    ) + ") u WHERE ratio >= 0.9",
)
def _(t):
    return profile.near_constants(t.bureau, 0.9).withColumn("ratio", r4("ratio"))


_MISSING_SQL = "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{kind}' AS dtype,
        CAST(count(*) - count({c}) AS BIGINT) AS n_miss, round((count(*) - count({c})) * 1e0 / count(*) * 100, 2) AS ratio FROM {{bureau}}"""
    for c, kind in _PROFILED.items()
) + ") m WHERE n_miss > 0"


@query(
    "p10_small_ratio",
    f"""SELECT 'l_partkey' AS "column", CAST(l_partkey AS STRING) AS top_value, CAST(count(*) AS BIGINT) AS n,
        {sql_r4("count(*) * 1e0 / (SELECT count(*) FROM lineitem)")} AS ratio FROM lineitem
        GROUP BY l_partkey ORDER BY count(*) DESC, top_value LIMIT 1""",
)
def _(t):
    found = profile.near_constants(t.table("lineitem").select("l_partkey"), 1e-5)
    return found.withColumn("ratio", r4("ratio"))


@query(
    "p11_nan",
    """SELECT 'price' AS "column", 'double' AS dtype, CAST(count(*) AS BIGINT) AS n_miss,
       round(count(*) * 1e0 / (SELECT count(*) FROM orders) * 100, 2) AS ratio FROM orders WHERE o_orderkey % 5 < 2""",
)
def _(t):
    rows = t.table("orders").selectExpr(
        "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END AS price", "o_orderkey"
    )
    return profile.missing_values_table(rows)


@query("p11_missing_table", _MISSING_SQL)
def _(t):
    return profile.missing_values_table(t.bureau)


@query("p12_missing_short", f"SELECT * EXCLUDE (dtype) FROM ({_MISSING_SQL}) s")
def _(t):
    return profile.missing_values_table(t.bureau, with_dtype=False)


@query("p13_mostly_missing", "SELECT SK_ID_BUREAU, AMT_CREDIT_MAX_OVERDUE FROM {bureau}")
def _(t):
    names = profile.mostly_missing(t.bureau, 40.0)
    return t.bureau.select("SK_ID_BUREAU", *names)


_FLAGGED = ("OCCUPATION_TYPE", "AMT_ANNUITY", "OWN_CAR_AGE")


@query(
    "p14_missing_vs_target",
    " UNION ALL ".join(
        f"""SELECT '{c}_NA_FLAG' AS "column", CAST(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS BIGINT) AS flag,
            {sql_r4("avg(TARGET)")} AS target_mean, CAST(count(TARGET) AS BIGINT) AS n FROM {{application}} GROUP BY 2"""
        for c in _FLAGGED
    ),
)
def _(t):
    table = profile.missing_vs_target(t.application, "TARGET", _FLAGGED)
    return table.select("column", F.col("flag").cast("long").alias("flag"), r4("target_mean").alias("target_mean"), "n")


@query(
    "p15_rare_analysis",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS level, CAST(count(*) AS BIGINT) AS n, {sql_r4("avg(TARGET)")} AS target_mean,
            {sql_r4("count(*) * 1e0 / (SELECT count(*) FROM {application})")} AS ratio,
            (SELECT CAST(count(DISTINCT {c}) AS BIGINT) FROM {{application}}) AS n_levels
            FROM {{application}} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in ("OCCUPATION_TYPE", "NAME_HOUSING_TYPE")
    ),
)
def _(t):
    table = profile.rare_analyser(t.application, "TARGET", ["OCCUPATION_TYPE", "NAME_HOUSING_TYPE"])
    return table.withColumns({"ratio": r4("ratio"), "target_mean": r4("target_mean")})


@query(
    "p16_target_percent",
    f"""SELECT NAME_FAMILY_STATUS, {sql_r4("100e0 * sum(1 - TARGET) / count(*)")} AS percent_0,
        {sql_r4("100e0 * sum(TARGET) / count(*)")} AS percent_1 FROM {{application}}
        WHERE NAME_FAMILY_STATUS IS NOT NULL GROUP BY NAME_FAMILY_STATUS""",
)
def _(t):
    return rounded(profile.target_percent(t.application, "NAME_FAMILY_STATUS", "TARGET"), ["NAME_FAMILY_STATUS"])


_BINNED = ("o_totalprice", "o_custkey")


@query(
    "p18_histogram",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(least(floor((CAST({c} AS DOUBLE) - lo) / (hi - lo) * 20), 19) + 1 AS BIGINT) AS bin,
            CAST(count(*) AS BIGINT) AS n
            FROM orders, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM orders) e GROUP BY 2"""
        for c in _BINNED
    ),
)
def _(t):
    return profile.histogram(t.table("orders"), _BINNED, 20)


@query(
    "p19_count_by_category",
    """SELECT NAME_CONTRACT_TYPE, CAST(TARGET AS BIGINT) AS TARGET, CAST(count(*) AS BIGINT) AS n
       FROM {application} GROUP BY NAME_CONTRACT_TYPE, TARGET""",
)
def _(t):
    counts = profile.counts_by_category(t.application, "NAME_CONTRACT_TYPE", "TARGET")
    return counts.withColumn("TARGET", F.col("TARGET").cast("long"))


@query(
    "p20_corr_long",
    sql_rounded(
        f"""SELECT col_a, col_b, r FROM ({sql_correlations(CORRELATED, "{application}")}) x
            UNION ALL SELECT col_b, col_a, r FROM ({sql_correlations(CORRELATED, "{application}")}) y
            UNION ALL """ + " UNION ALL ".join(f"SELECT '{c}', '{c}', 1" for c in CORRELATED),
        ["col_a", "col_b"],
    ),
)
def _(t):
    return rounded(correlation.correlation_matrix_long(t.application, CORRELATED), ["col_a", "col_b"])


# --- outliers ---------------------------------------------------------------------------------

_FENCED = ("l_extendedprice", "l_tax", "skewed")
_SKEWED = "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity * l_quantity * (l_linenumber % 3) END"
_FENCE_ROWS = f"(SELECT *, {_SKEWED} AS skewed FROM lineitem)"


def _fence_rows(t):
    return t.table("lineitem").withColumn("skewed", F.expr(_SKEWED))


def _sql_fences(c: str) -> str:
    return f"""(SELECT q1 - 1.5e0 * (q3 - q1) AS low, q3 + 1.5e0 * (q3 - q1) AS up FROM
        (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {_FENCE_ROWS} f) q)"""


@query(
    "o1_fences",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {sql_r4('low')} AS low, {sql_r4('up')} AS up FROM {_sql_fences(c)} z" for c in _FENCED
    ),
)
def _(t):
    return rounded(outliers.fence_table(_fence_rows(t), _FENCED), ["column"])


_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "o2_winsorise",
    f"""SELECT {', '.join(_LINE_KEYS)}, {sql_r4("CASE WHEN skewed < low THEN low WHEN skewed > up THEN up ELSE skewed END")} AS skewed
        FROM {_FENCE_ROWS} r, {_sql_fences("skewed")} z""",
)
def _(t):
    return rounded(outliers.winsorise(_fence_rows(t), ["skewed"]).select(*_LINE_KEYS, "skewed"), _LINE_KEYS)


@query(
    "o3_has_outlier",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce(bool_or({c} < low OR {c} > up), FALSE) AS has_outlier FROM {_FENCE_ROWS} r, {_sql_fences(c)} z"
        for c in _FENCED
    ),
)
def _(t):
    return outliers.has_outliers(_fence_rows(t), _FENCED)


@query(
    "o4_outlier_rows",
    f"""WITH hits AS (SELECT rid, skewed FROM (SELECT *, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS rid
          FROM {_FENCE_ROWS} r) r, {_sql_fences("skewed")} z WHERE skewed < low OR skewed > up)
        SELECT rid, skewed FROM hits ORDER BY rid LIMIT 5""",
)
def _(t):
    rows = _fence_rows(t).select(F.expr("l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey").alias("rid"), "skewed")
    return outliers.grab_outliers(rows, "skewed", "rid")


@query(
    "o4_outlier_ids",
    f"""SELECT l_orderkey FROM {_FENCE_ROWS} r, {_sql_fences("skewed")} z WHERE skewed < low OR skewed > up""",
)
def _(t):
    return outliers.grab_outliers(_fence_rows(t), "skewed", "l_orderkey", ids_only=True)


@query(
    "o5_remove",
    f"""SELECT {', '.join(_LINE_KEYS)}, skewed FROM {_FENCE_ROWS} r, {_sql_fences("skewed")} z
        WHERE NOT (skewed < low OR skewed > up) OR skewed IS NULL""",
)
def _(t):
    return outliers.remove_outliers(_fence_rows(t), "skewed").select(*_LINE_KEYS, "skewed")


# --- duplicates, sorts, top-k -----------------------------------------------------------------


@query(
    "d1_dup_rows",
    """SELECT user_id, event_type FROM (SELECT user_id, event_type,
       row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) e WHERE rn > 1""",
)
def _(t):
    return duplicates.expand_copies(duplicates.duplicate_rows(t.table("events").select("user_id", "event_type")))


@query(
    "d1_copied_documents",
    """SELECT text, lang, source, n_chars FROM (SELECT text, lang, source, n_chars,
       row_number() OVER (PARTITION BY text, lang, source, n_chars ORDER BY doc_id) AS rn FROM documents) d WHERE rn > 1""",
)
def _(t):
    return duplicates.expand_copies(duplicates.duplicate_rows(t.table("documents").drop("doc_id")))


@query(
    "d2_dup_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER
       (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem) l WHERE rn > 1""",
)
def _(t):
    repeated = duplicates.duplicate_keys(
        t.table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate"]
    )
    return repeated.select(*_LINE_KEYS)


@query(
    "d2_ties",
    """SELECT o_custkey, o_orderstatus, o_orderpriority FROM (SELECT o_custkey, o_orderstatus, o_orderpriority, row_number() OVER
       (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderpriority) AS rn FROM orders) o WHERE rn > 1""",
)
def _(t):
    rows = t.table("orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return duplicates.duplicate_keys(rows, ["o_custkey"], ["o_orderstatus"])


@query("t2_sort_missing", _MISSING_SQL + " ORDER BY n_miss DESC, \"column\"")
def _(t):
    return profile.missing_values_table(t.bureau)


@query(
    "t4_topk",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def _(t):
    ranked = t.table("orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return ranked.limit(20).select("o_orderkey", "o_totalprice")


@query(
    "t5_sorted_levels",
    """SELECT v AS o_orderpriority, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS code
       FROM (SELECT DISTINCT o_orderpriority AS v FROM orders) d""",
)
def _(t):
    levels = t.table("orders").select("o_orderpriority").distinct()
    return sorted_codes(levels, "o_orderpriority").withColumnRenamed("_code", "code")
