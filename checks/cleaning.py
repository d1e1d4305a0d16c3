"""White space, empty rows and columns, duplicates, column choice."""

from __future__ import annotations

from pyspark.sql import functions as F

import tidyveil as tv
from checks.registry import check, table


@check("trim_whitespace", 'SELECT p_partkey, p_name AS "part name", p_type FROM part')
def _(spark, folder):
    messy = table(spark, folder, "part").select(
        "p_partkey",
        F.concat(F.lit("   "), F.replace("p_name", F.lit(" "), F.lit(" \t  ")), F.lit(" \n")).alias("  part name "),
        F.concat(F.lit("\t"), "p_type").alias("p_type"),
    )
    return tv.trim_whitespace(messy)


@check(
    "trim_whitespace_documents",
    r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, lang, source, n_chars FROM documents",
)
def _(spark, folder):
    return tv.trim_whitespace(table(spark, folder, "documents"))


@check(
    "remove_empty_rows",
    "SELECT event_id, value, props FROM events WHERE event_type <> 'error'",
)
def _(spark, folder):
    gone = F.col("event_type") == "error"
    messy = table(spark, folder, "events").select(
        F.when(~gone, F.col("event_id")).alias("event_id"),
        F.when(gone, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.when(gone, F.lit(" \t ")).otherwise(F.col("props")).alias("props"),
    )
    return tv.remove_empty_rows(messy)


@check("remove_empty_columns", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, folder):
    messy = table(spark, folder, "orders").select(
        "o_orderkey",
        F.lit(None).cast("double").alias("nothing"),
        "o_orderpriority",
        F.lit("  ").alias("blank"),
        F.lit(float("nan")).alias("no number"),
    )
    return tv.remove_empty_columns(messy)


@check("drop_placeholder_columns", "SELECT o_orderkey, '  ' AS blank FROM orders")
def _(spark, folder):
    messy = table(spark, folder, "orders").select(
        "o_orderkey",
        F.lit(None).cast("string").alias("nothing"),
        F.col("o_orderpriority").alias("Unnamed: 2"),
        F.lit("  ").alias("blank"),
    )
    return tv.drop_placeholder_columns(messy)


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus"
_KEPT = "l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@check("remove_duplicates_rows", "SELECT DISTINCT text, lang FROM documents")
def _(spark, folder):
    return tv.remove_duplicates(table(spark, folder, "documents").select("text", "lang"))


@check(
    "remove_duplicates_first",
    f"""SELECT {_KEPT} FROM (SELECT *, row_number() OVER (
        PARTITION BY l_orderkey, l_returnflag ORDER BY {_ORDER}) AS n FROM lineitem) WHERE n = 1""",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem")
    kept = tv.remove_duplicates(rows, ["l_orderkey", "l_returnflag"], "first", _ORDER.split(", "))
    return kept.select(*_KEPT.split(", "))


@check(
    "remove_duplicates_last",
    f"""SELECT {_KEPT} FROM (SELECT *, row_number() OVER (
        PARTITION BY l_orderkey, l_returnflag
        ORDER BY {', '.join(c + ' DESC' for c in _ORDER.split(', '))}) AS n FROM lineitem) WHERE n = 1""",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem")
    kept = tv.remove_duplicates(rows, ["l_orderkey", "l_returnflag"], "last", _ORDER.split(", "))
    return kept.select(*_KEPT.split(", "))


@check(
    "remove_duplicates_none_kept",
    f"""SELECT {_KEPT} FROM (SELECT *, count(*) OVER (
        PARTITION BY l_orderkey, l_returnflag) AS n FROM lineitem) WHERE n = 1""",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem")
    return tv.remove_duplicates(rows, ["l_orderkey", "l_returnflag"], keep=False).select(*_KEPT.split(", "))


@check(
    "remove_duplicates_hot_key",
    """SELECT l_linestatus, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (
        PARTITION BY l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
        l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1""",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    kept = tv.remove_duplicates(rows, ["l_linestatus"], "first", order)
    return kept.select("l_linestatus", "l_orderkey", "l_extendedprice")


@check("select_columns", "SELECT c_mktsegment, c_custkey FROM customer")
def _(spark, folder):
    return tv.select_columns(table(spark, folder, "customer"), ["c_mktsegment", "no such", "c_custkey"])


@check("remove_columns", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, folder):
    return tv.remove_columns(table(spark, folder, "customer"), ["c_name", "c_nationkey", "c_mktsegment", "no such"])


@check("rename_columns", "SELECT c_custkey, c_mktsegment AS c_name, c_name AS c_mktsegment FROM customer")
def _(spark, folder):
    renamed = tv.rename_columns(
        table(spark, folder, "customer"), {"c_name": "c_mktsegment", "c_mktsegment": "c_name", "no such": "x"}
    )
    return renamed.select("c_custkey", "c_name", "c_mktsegment")


@check("reorder_columns", "SELECT p_type, p_brand, p_partkey, p_name, p_size, p_retailprice FROM part")
def _(spark, folder):
    return tv.reorder_columns(table(spark, folder, "part"), ["p_type", "no such", "p_brand"])
