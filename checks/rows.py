"""Row predicates, previews and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

import tidyveil as tv
from checks.registry import check, table
from tidyveil.sources import ROW_ORDER, with_row_id

_LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(*_LINE)


def _gapped(spark, folder):
    """events whose value is missing where the event is an error."""
    return table(spark, folder, "events").select(
        "event_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )


_GAPPED = "(SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"
_LINES = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE "


@check("filter_equal", _LINES + "l_returnflag = 'R'")
def _(spark, folder):
    return tv.filter_rows(_lines(spark, folder), "l_returnflag", "==", "R")


@check("filter_equal_typed", _LINES + "l_quantity = 10")
def _(spark, folder):
    return tv.filter_rows(_lines(spark, folder), "l_quantity", "==", "10")


@check("filter_not_equal", f"SELECT * FROM {_GAPPED} WHERE value IS NULL OR value <> 1.63")
def _(spark, folder):
    return tv.filter_rows(_gapped(spark, folder), "value", "!=", "1.63")


@check("filter_greater", _LINES + "l_quantity > 25")
def _(spark, folder):
    return tv.filter_rows(_lines(spark, folder), "l_quantity", ">", 25)


@check("filter_less", f"SELECT * FROM {_GAPPED} WHERE value < 12.5")
def _(spark, folder):
    return tv.filter_rows(_gapped(spark, folder), "value", "<", "12.5")


@check("filter_at_least", _LINES + "l_orderkey >= 7000")
def _(spark, folder):
    return tv.filter_rows(_lines(spark, folder), "l_orderkey", ">=", 7000)


@check("filter_at_most", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 100000")
def _(spark, folder):
    money = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return tv.filter_rows(money, "o_totalprice", "<=", "100000")


@check("filter_contains", r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)EXAMPLE\.(com|org)/en')")
def _(spark, folder):
    return tv.filter_rows(table(spark, folder, "pages").select("page_id", "url"), "url", "contains", r"EXAMPLE\.(com|org)/en")


@check("filter_contains_literal", "SELECT page_id, url FROM pages WHERE contains(lower(url), '?page=')")
def _(spark, folder):
    return tv.filter_rows(table(spark, folder, "pages").select("page_id", "url"), "url", "contains", "?PAGE=", literal=True)


@check("filter_not_contains", "SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, '(?i)licen[cs]e')")
def _(spark, folder):
    kept = tv.filter_rows(table(spark, folder, "documents"), "text", "not_contains", "licen[cs]e")
    return kept.select("doc_id", "lang")


@check(
    "search_rows",
    """SELECT * FROM customer WHERE contains(lower(CAST(c_custkey AS VARCHAR)), '42') OR contains(lower(c_name), '42')
       OR contains(CAST(c_nationkey AS VARCHAR), '42') OR contains(CAST(c_acctbal AS VARCHAR), '42')
       OR contains(lower(c_mktsegment), '42')""",
)
def _(spark, folder):
    return tv.search_rows(table(spark, folder, "customer"), " 42 ")


@check("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 200")
def _(spark, folder):
    return tv.preview(table(spark, folder, "orders"), order_by=["o_orderkey"])


@check(
    "page",
    "SELECT o_orderkey, o_custkey, (SELECT CAST(ceil(count(*) / 50.0) AS INTEGER) FROM orders) AS pages "
    "FROM orders ORDER BY o_custkey, o_orderkey LIMIT 50 OFFSET 150",
)
def _(spark, folder):
    rows, pages = tv.page(table(spark, folder, "orders"), 3, 50, ["o_custkey", "o_orderkey"])
    return rows.select("o_orderkey", "o_custkey", F.lit(pages).alias("pages"))


@check(
    "page_deep",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber, "
    # A page beyond the last one gives the first.
    "l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 500 "
    "OFFSET (SELECT CASE WHEN 50 < ceil(count(*) / 500.0) THEN 25000 ELSE 0 END FROM lineitem)",
)
def _(spark, folder):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows, _ = tv.page(table(spark, folder, "lineitem"), 50, 500, order)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@check("row_id_first_seen", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, folder):
    # orders lie in the file by o_orderkey, so the first row of a customer has the least one.
    numbered = with_row_id(table(spark, folder, "orders"))
    return tv.remove_duplicates(numbered, ["o_custkey"], "first", ROW_ORDER).select("o_custkey", "o_orderkey")
