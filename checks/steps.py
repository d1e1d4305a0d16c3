"""Lists of steps, saved specs, step figures, fingerprints."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

import tidyveil as tv
from checks.registry import check, table
from tidyveil.plans.fingerprint import table_fingerprint
from tidyveil.plans.steps import Step

CUSTOMER_STEPS = [
    Step("TRIM_WHITESPACE"),
    Step("MASK_COLUMN", {"column": "c_name"}),
    Step("HASH_COLUMN", {"column": "c_custkey", "salt": "s"}),
    Step("REVENUE_BANDS", {"column": "c_acctbal"}),
    Step("SUPPRESS_LOW_COUNTS", {"group_column": "c_nationkey", "threshold": 60}),
]
CUSTOMER_SQL = """SELECT sha256('s' || CAST(c_custkey AS VARCHAR)) AS c_custkey,
    repeat('*', length(c_name) - 4) || right(c_name, 4) AS c_name,
    CASE WHEN count(*) OVER (PARTITION BY c_nationkey) < 60 THEN '[SUPPRESSED]' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
    CASE WHEN c_acctbal <= 10000 THEN '<10K' ELSE '10K–50K' END AS c_acctbal, c_mktsegment FROM customer"""


def protect_customers(spark, folder):
    padded = table(spark, folder, "customer").withColumn("c_name", F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return tv.run_steps(padded, CUSTOMER_STEPS)


@check("run_steps", CUSTOMER_SQL)
def _(spark, folder):
    return protect_customers(spark, folder).data


_SPEC = {
    "schema_version": 1,
    "name": "orders for sharing",
    "steps": [
        {"transform_type": "FILTER_ROWS", "params": {"column": "o_orderstatus", "operator": "!=", "value": "P"}},
        {"transform_type": "REMOVE_DUPLICATES", "params": {"subset": ["o_custkey", "o_orderdate"]}},
        {"transform_type": "FILL_MISSING", "params": {"column": "price", "strategy": "median"}},
        {"transform_type": "MASK_COLUMN", "enabled": False, "params": {"column": "o_orderpriority"}},
        {"transform_type": "REPLACE_VALUES", "params": {"column": "o_orderpriority", "find": "-", "replace": " "}},
        {"transform_type": "SUPPRESS_LOW_COUNTS", "params": {"column": "o_orderdate", "threshold": 3}},
        {"transform_type": "REMOVE_COLUMNS", "params": {"columns": ["o_orderstatus", "o_totalprice"]}},
    ],
}
_SPEC_SQL = """WITH a AS (SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price FROM orders WHERE o_orderstatus <> 'P'),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS n FROM a) WHERE n = 1)
    """


def _spec_run(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority",
        "o_orderstatus",
        "o_totalprice",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"),
    )
    return tv.run_steps(orders, json.dumps(_SPEC), order_by=["o_orderkey"])


@check(
    "run_saved_steps",
    _SPEC_SQL
    + """SELECT o_orderkey, o_custkey, CASE WHEN count(*) OVER (PARTITION BY o_orderdate) < 3 THEN '[SUPPRESSED]' ELSE o_orderdate END AS o_orderdate,
         replace(o_orderpriority, '-', ' ') AS o_orderpriority, round(coalesce(price, (SELECT median(price) FROM b)), 4) AS price FROM b""",
)
def _(spark, folder):
    return _spec_run(spark, folder).data.withColumn("price", F.round("price", 4))


@check(
    "step_metrics",
    _SPEC_SQL
    + """SELECT * FROM (SELECT (SELECT count(*) FROM orders) AS n0, (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2),
         LATERAL (VALUES (1, 'Filter Rows', n0, n1, 7, 7), (2, 'Remove Duplicates', n1, n2, 7, 7), (3, 'Fill Missing Values', n2, n2, 7, 7),
                         (4, 'Replace Values', n2, n2, 7, 7), (5, 'Suppress Low Counts', n2, n2, 7, 7), (6, 'Remove Columns', n2, n2, 7, 5))
         AS m(step, step_name, rows_before, rows_after, cols_before, cols_after)""".replace(
        "SELECT * FROM (", "SELECT step, step_name, rows_before, rows_after, cols_before, cols_after, true AS success FROM ("
    ),
)
def _(spark, folder):
    return _spec_run(spark, folder).metrics().drop("error")


_PIECES = [f"SELECT sum(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT) AS s{i} FROM r" for i in range(4)]


@check(
    "table_fingerprint_strong",
    f"""WITH r AS (SELECT sha256(concat_ws(',', {', '.join(
        f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "text", "lang", "source", "n_chars"))})) AS d
        FROM documents)
        SELECT (SELECT count(*) FROM r) AS "rows", sha256((SELECT count(*) FROM r) || ':' || {" || ':' || ".join(f"({p})" for p in _PIECES)}) AS fingerprint""",
)
def _(spark, folder):
    return table_fingerprint(table(spark, folder, "documents"), strong=True)


@check("table_fingerprint")
def _(spark, folder):
    return table_fingerprint(table(spark, folder, "lineitem"))
