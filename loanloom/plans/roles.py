"""Role tables (applicants, loans, balances, payments) derived from the star-schema test tables.

Each column is one expression that Spark and other SQL engines read alike; only
the day difference is spelt per engine, through ``days(column, anchor)``.
Amounts are whole numbers, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Days = Callable[[str, str], str]

ORDER_ANCHOR = "DATE '2001-08-01'"
SHIP_ANCHOR = "DATE '2001-11-04'"
EVENT_ANCHOR = "DATE '2024-01-31'"


def _money(expr: str) -> str:
    return f"CAST(floor({expr}) AS DOUBLE)"


def application(days: Days) -> dict[str, str]:
    k = "c_custkey"
    columns = {
        "SK_ID_CURR": k,
        "TARGET": "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END",
        "NAME_CONTRACT_TYPE": "c_mktsegment",
        "CODE_GENDER": f"CASE WHEN {k} % 7 = 0 THEN 'XNA' WHEN {k} % 2 = 0 THEN 'M' ELSE 'F' END",
        "NAME_TYPE_SUITE": "nullif(concat('Suite ', CAST(c_nationkey % 5 AS STRING)), 'Suite 0')",
        "NAME_FAMILY_STATUS": f"CASE {k} % 5 WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Married' "
        "WHEN 3 THEN 'Single' WHEN 4 THEN 'Widow' END",
        "NAME_HOUSING_TYPE": "nullif(concat('House-', CAST(c_nationkey % 4 AS STRING)), 'House-3')",
        "NAME_EDUCATION_TYPE": f"concat('Level ', CAST({k} % 3 AS STRING))",
        "OCCUPATION_TYPE": "nullif(concat('Job/', CAST(c_nationkey AS STRING)), 'Job/0')",
        "ORGANIZATION_TYPE": "concat('Org ', CAST(c_nationkey % 10 AS STRING))",
        "CNT_CHILDREN": f"CAST({k} % 4 AS INT)",
        "CNT_FAM_MEMBERS": f"CAST(nullif({k} % 6, 0) AS DOUBLE)",
        "AMT_INCOME_TOTAL": f"{_money('c_acctbal')} + 2000",
        "AMT_CREDIT": f"{_money('abs(c_acctbal)')} * 10 + 5000",
        "AMT_ANNUITY": f"CAST(nullif({k} % 11, 0) AS DOUBLE) * 100",
        "AMT_GOODS_PRICE": f"CAST(nullif({k} % 13, 0) AS DOUBLE) * 1000",
        "DAYS_BIRTH": f"CAST(-7000 - ({k} * 37) % 15000 AS INT)",
        "DAYS_EMPLOYED": f"CAST(CASE WHEN {k} % 6 = 0 THEN 365243 ELSE -1 - ({k} * 13) % 5000 END AS INT)",
        "DAYS_ID_PUBLISH": f"CAST(0 - ({k} * 17) % 6000 AS INT)",
        "DAYS_REGISTRATION": f"CAST(-1 - ({k} * 7) % 9000 AS DOUBLE)",
        "DAYS_LAST_PHONE_CHANGE": f"CAST(0 - ({k} * 3) % 2000 AS DOUBLE)",
        "OWN_CAR_AGE": f"CAST(CASE WHEN {k} % 3 = 0 THEN NULL ELSE {k} % 40 END AS DOUBLE)",
        "EXT_SOURCE_1": f"CAST(nullif({k} % 64, 0) AS DOUBLE) / 64",
        "EXT_SOURCE_2": f"CAST(nullif({k} % 32, 0) AS DOUBLE) / 32",
        "EXT_SOURCE_3": f"CAST(nullif({k} % 16, 0) AS DOUBLE) / 16",
        "FLAG_MOBIL": "1",
        "FLAG_EMP_PHONE": f"CAST({k} % 2 AS INT)",
        "FLAG_CONT_MOBILE": f"CAST(nullif({k} % 3, 2) AS INT)",
        "FLAG_EMAIL": f"CASE WHEN {k} % 9 = 0 THEN 1 ELSE 0 END",
    }
    for n in range(2, 22):
        columns[f"FLAG_DOCUMENT_{n}"] = f"CASE WHEN {k} % {n} = 0 THEN 1 ELSE 0 END"
    return columns


def bureau(days: Days) -> dict[str, str]:
    k, d = "o_orderkey", days("o_orderdate", ORDER_ANCHOR)
    return {
        "SK_ID_BUREAU": k,
        "SK_ID_CURR": "o_custkey",
        "CREDIT_ACTIVE": f"CASE WHEN {k} % 50 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Closed' "
        "WHEN o_orderstatus = 'O' THEN 'Active' ELSE 'Sold' END",
        "CREDIT_TYPE": "nullif(o_orderpriority, '4-NOT SPECIFIED')",
        "DAYS_CREDIT": f"CAST({d} AS INT)",
        "DAYS_CREDIT_ENDDATE": f"CAST({d} + {k} % 900 AS DOUBLE)",
        "DAYS_ENDDATE_FACT": f"CASE WHEN {k} % 3 = 0 THEN NULL ELSE CAST({d} + {k} % 700 AS DOUBLE) END",
        "DAYS_CREDIT_UPDATE": f"CAST({d} + {k} % 60 AS INT)",
        "CREDIT_DAY_OVERDUE": f"CAST(CASE WHEN {k} % 20 = 0 THEN {k} % 90 ELSE 0 END AS INT)",
        "CNT_CREDIT_PROLONG": f"CASE WHEN {k} % 25 = 0 THEN 1 ELSE 0 END",
        "AMT_CREDIT_SUM": f"CASE WHEN {k} % 97 = 0 THEN NULL ELSE {_money('o_totalprice')} END",
        "AMT_CREDIT_SUM_DEBT": f"CASE WHEN {k} % 4 = 0 THEN NULL WHEN {k} % 4 = 1 THEN CAST(0 AS DOUBLE) "
        f"ELSE {_money('o_totalprice / 2')} END",
        "AMT_CREDIT_SUM_LIMIT": f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE CAST({k} % 1000 AS DOUBLE) END",
        "AMT_CREDIT_SUM_OVERDUE": f"CAST(CASE WHEN {k} % 30 = 0 THEN {k} % 500 ELSE 0 END AS DOUBLE)",
        "AMT_CREDIT_MAX_OVERDUE": f"CASE WHEN {k} % 2 = 0 THEN NULL ELSE CAST({k} % 3000 AS DOUBLE) END",
        "AMT_ANNUITY": f"CASE WHEN {k} % 3 = 1 THEN NULL ELSE {_money('o_totalprice / 12')} END",
    }


def bureau_balance(days: Days) -> dict[str, str]:
    d = days("l_shipdate", SHIP_ANCHOR)
    return {
        "SK_ID_BUREAU": "l_orderkey",
        "MONTHS_BALANCE": f"CAST(({d} - {d} % 30) / 30 AS INT)",
        "STATUS": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END",
    }


# Per order: what its lines add up to.
LINE_SUMS = {
    "ls_orderkey": "l_orderkey",
    "ls_credit": f"sum({_money('l_extendedprice * (1 - l_discount)')})",
    "ls_lines": "count(*)",
}


def previous(days: Days) -> dict[str, str]:
    k, d = "o_orderkey", days("o_orderdate", ORDER_ANCHOR)

    def day(every: int, zero_every: int, spread: int) -> str:
        return (
            f"CASE WHEN {k} % {every} = 0 THEN CAST(365243 AS DOUBLE) "
            f"WHEN {k} % {zero_every} = 0 THEN CAST(0 AS DOUBLE) "
            f"WHEN {k} % 17 = 0 THEN NULL ELSE CAST({d} + {k} % {spread} AS DOUBLE) END"
        )

    return {
        "SK_ID_PREV": k,
        "SK_ID_CURR": "o_custkey",
        "NAME_CONTRACT_STATUS": "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'P' THEN 'Refused' "
        "ELSE 'Canceled' END",
        "NAME_PAYMENT_TYPE": "nullif(o_orderpriority, '4-NOT SPECIFIED')",
        "AMT_APPLICATION": _money("o_totalprice"),
        "AMT_CREDIT": "ls_credit",
        "AMT_ANNUITY": f"CASE WHEN {k} % 19 = 0 THEN NULL ELSE {_money(f'o_totalprice / ({k} % 12 + 6)')} END",
        "AMT_DOWN_PAYMENT": f"CASE WHEN {k} % 3 = 0 THEN NULL ELSE {_money('o_totalprice / 10')} END",
        "AMT_GOODS_PRICE": f"CASE WHEN {k} % 23 = 0 THEN NULL ELSE {_money('o_totalprice / 2')} END",
        "HOUR_APPR_PROCESS_START": f"CAST({k} % 24 AS INT)",
        "RATE_DOWN_PAYMENT": f"CAST(nullif({k} % 16, 0) AS DOUBLE) / 16",
        "RATE_INTEREST_PRIMARY": f"CAST(nullif({k} % 8, 0) AS DOUBLE) / 8",
        "RATE_INTEREST_PRIVILEGED": f"CASE WHEN {k} % 2 = 0 THEN NULL ELSE CAST({k} % 4 AS DOUBLE) / 4 END",
        "DAYS_DECISION": f"CAST({d} AS INT)",
        "CNT_PAYMENT": "CAST(ls_lines AS DOUBLE)",
        "DAYS_FIRST_DRAWING": day(4, 10_000_000, 30),
        "DAYS_FIRST_DUE": day(9, 11, 40),
        "DAYS_LAST_DUE_1ST_VERSION": day(8, 13, 400),
        "DAYS_LAST_DUE": day(7, 15, 380),
        "DAYS_TERMINATION": day(6, 14, 390),
    }


def pos(days: Days) -> dict[str, str]:
    d = days("l_shipdate", SHIP_ANCHOR)
    late = f"({days('l_shipdate', SHIP_ANCHOR)} - ({days('o_orderdate', SHIP_ANCHOR)}))"
    return {
        "SK_ID_PREV": "l_orderkey",
        "SK_ID_CURR": "o_custkey",
        "MONTHS_BALANCE": f"CAST(({d} - {d} % 30) / 30 AS INT)",
        "CNT_INSTALMENT": "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END",
        "CNT_INSTALMENT_FUTURE": "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END",
        "NAME_CONTRACT_STATUS": "CASE l_linestatus WHEN 'F' THEN 'Completed' ELSE 'Active' END",
        "SK_DPD": f"CAST(greatest({late} - 60, 0) AS INT)",
        "SK_DPD_DEF": f"CAST(greatest({late} - 200, 0) AS INT)",
        "TIE_LINE": "l_linenumber",
        "TIE_PART": "l_partkey",
        "TIE_SUPPLIER": "l_suppkey",
    }


POS_TIE_BREAK = ("TIE_LINE", "TIE_PART", "TIE_SUPPLIER")


def instalments(days: Days) -> dict[str, str]:
    d = days("l_shipdate", SHIP_ANCHOR)
    return {
        "SK_ID_PREV": "l_orderkey",
        "SK_ID_CURR": "o_custkey",
        "NUM_INSTALMENT_NUMBER": "l_linenumber",
        "NUM_INSTALMENT_VERSION": "CAST(nullif(l_suppkey % 20, 0) AS DOUBLE)",
        "DAYS_INSTALMENT": f"CAST({d} AS DOUBLE)",
        "DAYS_ENTRY_PAYMENT": f"CASE WHEN l_partkey % 40 = 0 THEN NULL ELSE CAST({d} AS DOUBLE) + l_quantity - 25 END",
        "AMT_INSTALMENT": _money("l_extendedprice"),
        "AMT_PAYMENT": "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE "
        f"{_money('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} END",
    }


def card(days: Days) -> dict[str, str]:
    """The offset counts days here, since the events span one month."""
    k = "event_id"
    return {
        "SK_ID_PREV": "user_id * 10 + event_id % 3",
        "SK_ID_CURR": "user_id",
        "MONTHS_BALANCE": f"CAST({days('ts', EVENT_ANCHOR)} AS INT)",
        "AMT_BALANCE": f"CASE WHEN {k} % 13 = 0 THEN NULL ELSE {_money('value * 10')} END",
        "AMT_CREDIT_LIMIT_ACTUAL": f"CAST(({k} % 5) * 1000 AS DOUBLE)",
        "AMT_PAYMENT_CURRENT": _money("value"),
        "AMT_INST_MIN_REGULARITY": f"CAST(nullif({k} % 7, 0) * 10 AS DOUBLE)",
        "AMT_DRAWINGS_ATM_CURRENT": f"CAST({k} % 300 AS DOUBLE)",
        "AMT_RECIVABLE": _money("value * 9"),
        "SK_DPD": f"CAST(CASE WHEN {k} % 11 = 0 THEN {k} % 60 ELSE 0 END AS INT)",
        "NAME_CONTRACT_STATUS": "nullif(event_type, 'error')",
    }


CARD_SLICES = {"": None, "_year": 21, "_half_year": 14, "_quarter": 7, "_month": 3}


def _spark_days(column: str, anchor: str) -> str:
    return f"datediff(CAST({column} AS DATE), {anchor})"


class Roles:
    """Role tables as Spark frames over a folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _derive(self, source: DataFrame, columns: dict[str, str]) -> DataFrame:
        return source.select(*[F.expr(e).alias(n) for n, e in columns.items()])

    @property
    def application(self) -> DataFrame:
        return self._derive(self.table("customer"), application(_spark_days))

    @property
    def bureau(self) -> DataFrame:
        return self._derive(self.table("orders"), bureau(_spark_days))

    @property
    def bureau_balance(self) -> DataFrame:
        return self._derive(self.table("lineitem"), bureau_balance(_spark_days))

    @property
    def previous(self) -> DataFrame:
        sums = self.table("lineitem").groupBy(F.col("l_orderkey").alias("ls_orderkey")).agg(
            *[F.expr(e).alias(n) for n, e in LINE_SUMS.items() if n != "ls_orderkey"]
        )
        orders = self.table("orders")
        joined = orders.join(sums, orders.o_orderkey == sums.ls_orderkey, "left")
        return self._derive(joined, previous(_spark_days))

    def _lines(self) -> DataFrame:
        lines, orders = self.table("lineitem"), self.table("orders")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey)

    @property
    def pos(self) -> DataFrame:
        return self._derive(self._lines(), pos(_spark_days))

    @property
    def instalments(self) -> DataFrame:
        # What a line alone gives is derived before the join, which ships fewer and smaller columns than the raw ones.
        columns = instalments(_spark_days)
        lines = self.table("lineitem").select(*[F.expr(e).alias(n) for n, e in columns.items() if not e.startswith("o_")])
        orders = self.table("orders")
        joined = lines.join(orders, lines.SK_ID_PREV == orders.o_orderkey)
        return joined.select(*[F.expr(e).alias(n) if e.startswith("o_") else F.col(n) for n, e in columns.items()])

    @property
    def card(self) -> DataFrame:
        return self._derive(self.table("events"), card(_spark_days))
