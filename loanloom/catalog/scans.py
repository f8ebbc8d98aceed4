"""Sources, sinks, shapes and previews."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loanloom.catalog.registry import query
from loanloom.sources import (
    cache_or_load,
    narrow_types,
    narrowing_report,
    preview,
    read_csv,
    shape,
    shared_dir,
    tail,
)


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "s1_csv_scan",
    "SELECT * FROM orders",
)
def _(t):
    orders = t.table("orders")
    path = _fresh(t.spark, "orders-csv")
    orders.write.option("header", True).csv(path)
    return read_csv(t.spark, path, orders.schema)


@query(
    "s1_csv_markers",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus FROM orders""",
)
def _(t):
    marked = t.table("orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 6 = 0 THEN 'NaN' WHEN o_orderkey % 3 = 0 THEN 'NA' ELSE CAST(o_totalprice AS STRING) END AS o_totalprice",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE o_orderstatus END AS o_orderstatus",
    )
    path = _fresh(t.spark, "marked-csv")
    marked.write.option("header", True).csv(path)
    return read_csv(t.spark, path, infer=True).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


def _int_type(c: str) -> str:
    return f"""CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint'
        WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint'
        WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END"""


def _width(c: str) -> str:
    return f"CASE {c} WHEN 'tinyint' THEN 1 WHEN 'smallint' THEN 2 WHEN 'int' THEN 4 WHEN 'float' THEN 4 ELSE 8 END"


_LINE_INTS = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"}
_LINE_FLOATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "s2_narrow_types",
    f"""WITH chosen AS ({" UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", '{old}' AS old_type, {_int_type(c)} AS new_type, count(*) AS n FROM lineitem"
         for c, old in _LINE_INTS.items()]
        + [f"SELECT '{c}', 'double', CASE WHEN min({c}) > -3.4028234663852886e38 AND max({c}) < 3.4028234663852886e38 "
           f"THEN 'float' ELSE 'double' END, count(*) FROM lineitem" for c in _LINE_FLOATS])}),
    sized AS (SELECT "column", old_type, new_type,
        CAST(n * {_width("old_type")} AS BIGINT) AS old_bytes, CAST(n * {_width("new_type")} AS BIGINT) AS new_bytes
        FROM chosen)
    SELECT *, round((old_bytes - new_bytes) * 100e0 / old_bytes, 1) AS percent_saved FROM sized""",
)
def _(t):
    return narrowing_report(t.table("lineitem"))


@query(
    "s2_narrowed_rows",
    "SELECT * REPLACE ("
    + ", ".join([f"CAST({c} AS BIGINT) AS {c}" for c in _LINE_INTS] + [f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in _LINE_FLOATS])
    + ") FROM lineitem",
)
def _(t):
    narrowed = narrow_types(t.table("lineitem"))
    return narrowed.withColumns(
        {c: F.col(c).cast("long") for c in _LINE_INTS} | {c: F.col(c).cast("double") for c in _LINE_FLOATS}
    )


@query(
    "s3_cache_or_load",
    "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment",
)
def _(t):
    cached = cache_or_load(t.table("customer").select("c_custkey", "c_mktsegment"), _fresh(t.spark, "customer"))
    return cached.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


_SHAPED = {"customer": 5, "orders": 6, "lineitem": 11, "events": 6}


@query(
    "s5_shape",
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", CAST(count(*) AS BIGINT) AS n_rows, CAST({k} AS BIGINT) AS n_cols FROM {n}"
        for n, k in _SHAPED.items()
    ),
)
def _(t):
    result = None
    for name in _SHAPED:
        one = shape(t.table(name), name)
        result = one if result is None else result.unionByName(one)
    return result


@query(
    "s6_preview",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10",
)
def _(t):
    return preview(t.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), 10, ["o_orderkey"])


@query(
    "t3_tail",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5",
)
def _(t):
    return tail(t.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 5)
