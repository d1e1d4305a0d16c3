"""Filling missing values, normalizing types, replacing text."""

from __future__ import annotations

from pyspark.sql import functions as F

import tidyveil as tv
from checks.registry import check, table
from checks.rows import _GAPPED, _gapped


def _rounded(df, column="value"):
    return df.withColumn(column, F.round(column, 4))


@check("fill_missing_value", f"SELECT event_id, event_type, coalesce(value, -1.0) AS value FROM {_GAPPED}")
def _(spark, folder):
    return tv.fill_missing(_gapped(spark, folder), "value", "value", -1)


@check(
    "fill_missing_value_as_text",
    f"SELECT event_id, event_type, coalesce(CAST(value AS VARCHAR), 'unknown') AS value FROM {_GAPPED}",
)
def _(spark, folder):
    return tv.fill_missing(_gapped(spark, folder), "value", "value", "unknown")


@check(
    "fill_missing_mean",
    f"SELECT event_id, event_type, round(coalesce(value, (SELECT avg(value) FROM {_GAPPED})), 4) AS value FROM {_GAPPED}",
)
def _(spark, folder):
    return _rounded(tv.fill_missing(_gapped(spark, folder), "value", "mean"))


@check(
    "fill_missing_median",
    f"SELECT event_id, event_type, round(coalesce(value, (SELECT median(value) FROM {_GAPPED})), 4) AS value FROM {_GAPPED}",
)
def _(spark, folder):
    return _rounded(tv.fill_missing(_gapped(spark, folder), "value", "median"))


@check(
    "fill_missing_mode",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS v FROM orders)
       SELECT o_orderkey, coalesce(v, (SELECT v FROM t WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)) AS v
       FROM t""",
)
def _(spark, folder):
    gapped = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("v")
    )
    return tv.fill_missing(gapped, "v", "mode")


def _filled(direction, frame, partition=""):
    return f"""SELECT event_id, event_type, {direction}(value IGNORE NULLS) OVER (
        {partition} ORDER BY event_id ROWS BETWEEN {frame}) AS value FROM {_GAPPED}"""


@check("fill_missing_forward", _filled("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def _(spark, folder):
    return tv.fill_missing(_gapped(spark, folder), "value", "forward", order_by=["event_id"])


@check("fill_missing_backward", _filled("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def _(spark, folder):
    return tv.fill_missing(_gapped(spark, folder), "value", "backward", order_by=["event_id"])


_BY_USER = """SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
    FROM (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN props END AS v FROM events)"""


@check("fill_missing_forward_in_groups", _BY_USER)
def _(spark, folder):
    gapped = table(spark, folder, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("props")).alias("v")
    )
    filled = tv.fill_missing(gapped, "v", "forward", order_by=["ts", "event_id"], partition_by=["user_id"])
    return filled.select("event_id", "user_id", "v")


@check("fill_missing_drop", f"SELECT * FROM {_GAPPED} WHERE value IS NOT NULL")
def _(spark, folder):
    with_nan = _gapped(spark, folder).withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    return tv.fill_missing(with_nan, "value", "drop")


_STYLES = {  # a date style for each of the five order priorities
    "1-URGENT": "yyyy-MM-dd",
    "2-HIGH": "MM/dd/yyyy",
    "3-MEDIUM": "MMM d, yyyy",
    "4-NOT SPECIFIED": "' 'yyyy.MM.dd",
    "5-LOW": "d-MMMM-yyyy",
}


def _dated(spark, folder):
    when = F.when(F.lit(False), F.lit(None).cast("string"))
    for priority, style in _STYLES.items():
        when = when.when(F.col("o_orderpriority") == priority, F.date_format("o_orderdate", style))
    return table(spark, folder, "orders").select("o_orderkey", when.otherwise("n/a").alias("placed"))


@check("normalize_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS placed FROM orders")
def _(spark, folder):
    return tv.normalize_dates(_dated(spark, folder), "placed")


@check("normalize_dates_format", "SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS placed FROM orders")
def _(spark, folder):
    return tv.normalize_dates(_dated(spark, folder), "placed", "%d %b %Y")


@check("normalize_dates_timestamps", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS ts FROM events")
def _(spark, folder):
    texts = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(F.col("event_type") == "view", F.date_format("ts", "M/d/yyyy h:mm:ss a"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("ts"),
    )
    return tv.normalize_dates(texts, "ts", "%Y/%m/%d %H:%M:%S")


@check(
    "normalize_numbers",
    """SELECT o_orderkey, round(CASE o_orderpriority
         WHEN '1-URGENT' THEN o_totalprice
         WHEN '2-HIGH' THEN -o_totalprice
         WHEN '3-MEDIUM' THEN o_totalprice / 100
         WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_totalprice >= 1000 THEN o_totalprice ELSE o_totalprice * 100 END
         END, 4) AS price FROM orders""",
)
def _(spark, folder):
    grouped = F.format_number("o_totalprice", 2)
    messy = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit(" $"), grouped, F.lit(" ")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("("), grouped, F.lit(")")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(grouped, F.lit("%")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("€ "), F.translate(grouped, ",.", ".,")))
        .otherwise(F.concat(grouped, F.lit(" or so")))
        .alias("price"),
    )
    return _rounded(tv.normalize_numbers(messy, "price"), "price")


@check(
    "normalize_booleans",
    """SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false WHEN 'purchase' THEN true
       WHEN 'error' THEN false END AS flag FROM events""",
)
def _(spark, folder):
    kind = F.col("event_type")
    messy = table(spark, folder, "events").select(
        "event_id",
        F.when(kind == "click", " Yes ")
        .when(kind == "view", "0.0")
        .when(kind == "purchase", "ACTIVE")
        .when(kind == "error", "disabled")
        .otherwise("perhaps")
        .alias("flag"),
    )
    return tv.normalize_booleans(messy, "flag")


@check("replace_values", "SELECT p_partkey, replace(p_name, 'red ', 'crimson ') AS p_name, p_brand FROM part")
def _(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    return tv.replace_values(parts, "p_name", "red ", "crimson ")


@check(
    "replace_values_regex",
    r"SELECT doc_id, regexp_replace(text, '([A-Za-z0-9._%+-]+)@([A-Za-z0-9-]+)', '$<\2>', 'g') AS text FROM documents",
)
def _(spark, folder):
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return tv.replace_values(texts, "text", r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9-]+)", r"$<\2>", regex=True)
