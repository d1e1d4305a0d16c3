"""Masks, digests, pseudonyms, ranges, bands, suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

import tidyveil as tv
from checks.registry import SQL, check, table


def _mask(text, show):
    return f"CASE WHEN length({text}) <= {show} THEN repeat('*', length({text})) ELSE repeat('*', length({text}) - {show}) || right({text}, {show}) END"


@check("mask_column", f"SELECT c_custkey, {_mask('c_name', 4)} AS c_name FROM customer")
def _(spark, folder):
    return tv.mask_column(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_name")


@check("mask_column_fully", "SELECT o_orderkey, repeat('#', length(CAST(o_custkey AS VARCHAR))) AS o_custkey FROM orders")
def _(spark, folder):
    return tv.mask_column(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "#", 0)


@check("mask_column_documents", f"SELECT doc_id, {_mask('text', 10)} AS text FROM documents")
def _(spark, folder):
    return tv.mask_column(table(spark, folder, "documents").select("doc_id", "text"), "text", show_last=10)


@check(
    "redact_column",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN '[REDACTED]' END AS props FROM events",
)
def _(spark, folder):
    gapped = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("props")).alias("props")
    )
    return tv.redact_column(gapped, "props")


@check("hash_column", "SELECT doc_id, sha256('pepper' || text) AS text FROM documents")
def _(spark, folder):
    return tv.hash_column(table(spark, folder, "documents").select("doc_id", "text"), "text", salt="pepper")


@check("hash_column_md5", "SELECT o_orderkey, md5(CAST(o_totalprice AS VARCHAR)) AS o_totalprice FROM orders")
def _(spark, folder):
    return tv.hash_column(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "md5")


@check("hash_column_sha1", "SELECT o_orderkey, sha1('x' || CAST(o_custkey AS VARCHAR)) AS o_custkey FROM orders")
def _(spark, folder):
    return tv.hash_column(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "sha1", "x")


def _labels(source, text, prefix, seed):
    return f"""(SELECT k, '{prefix}_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS label
        FROM (SELECT k, row_number() OVER (ORDER BY md5('{seed}:' || k), k) AS n
              FROM (SELECT DISTINCT {text} AS k FROM {source} WHERE {text} IS NOT NULL)))"""


@check(
    "pseudonymize_column",
    f"""SELECT o_orderkey, label AS o_custkey FROM orders
        JOIN {_labels('orders', 'CAST(o_custkey AS VARCHAR)', 'ENTITY', 42)} ON k = CAST(o_custkey AS VARCHAR)""",
)
def _(spark, folder):
    return tv.pseudonymize_column(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@check(
    "pseudonymize_column_text",
    f"""SELECT doc_id, label AS text FROM documents JOIN {_labels('documents', 'text', 'Doc', 7)} ON k = text""",
)
def _(spark, folder):
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return tv.pseudonymize_column(texts, "text", prefix="Doc", seed=7)


@check(
    "generalize_bins",
    """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
       e AS (SELECT lo, hi, [CASE WHEN i = 5 THEN hi ELSE lo + i * ((hi - lo) / 5) END FOR i IN range(6)] AS x FROM s),
       b AS (SELECT c_custkey, x, 1 + (c_acctbal > x[2])::INT + (c_acctbal > x[3])::INT
                    + (c_acctbal > x[4])::INT + (c_acctbal > x[5])::INT AS i FROM customer, e)
       SELECT c_custkey, CASE WHEN i = 1 THEN '[' ELSE '(' END || CAST(round(x[i], 3) AS VARCHAR) || ', '
              || CAST(round(x[i + 1], 3) AS VARCHAR) || ']' AS c_acctbal FROM b""",
)
def _(spark, folder):
    return tv.generalize_column(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@check(
    "generalize_edges",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN NULL WHEN o_totalprice <= 50000 THEN '[1000, 50000]'
       WHEN o_totalprice <= 250000 THEN '(50000, 250000]' WHEN o_totalprice <= 400000 THEN '(250000, 400000]' END
       AS o_totalprice FROM orders""",
)
def _(spark, folder):
    money = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return tv.generalize_column(money, "o_totalprice", bins=[1000, 50_000, 250_000, 400_000])


@check(
    "generalize_labels",
    """WITH s AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)
       SELECT p_partkey, CASE WHEN p_size > lo + 2 * ((hi - lo) / 3) THEN 'large'
              WHEN p_size > lo + (hi - lo) / 3 THEN 'medium' ELSE 'small' END AS p_size FROM part, s""",
)
def _(spark, folder):
    sizes = table(spark, folder, "part").select("p_partkey", "p_size")
    return tv.generalize_column(sizes, "p_size", bins=3, labels=["small", "medium", "large"])


@check("generalize_round", "SELECT p_partkey, CAST(round(p_size / 10.0) * 10 AS BIGINT) AS p_size FROM part")
def _(spark, folder):
    return tv.generalize_column(table(spark, folder, "part").select("p_partkey", "p_size"), "p_size", round_to=10)


@check("generalize_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS o_orderdate FROM orders")
def _(spark, folder):
    dates = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return tv.generalize_column(dates, "o_orderdate", date_unit="month")


@check(
    "revenue_bands",
    """SELECT o_orderkey, CASE WHEN v <= 10000 THEN '<10K' WHEN v <= 50000 THEN '10K–50K' WHEN v <= 100000 THEN '50K–100K'
       WHEN v <= 500000 THEN '100K–500K' WHEN v <= 1000000 THEN '500K–1M' ELSE '1M+' END AS v
       FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN o_totalprice * 10 WHEN 'F' THEN 10000.0 ELSE o_totalprice END AS v FROM orders)""",
)
def _(spark, folder):
    money = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") * 10)
        .when(F.col("o_orderstatus") == "F", F.lit(10000.0))
        .otherwise(F.col("o_totalprice"))
        .alias("v"),
    )
    return tv.revenue_bands(money, "v")


@check(
    "suppress_low_counts",
    """SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id) < 66 THEN '[SUPPRESSED]'
       ELSE CAST(user_id AS VARCHAR) END AS user_id FROM events""",
)
def _(spark, folder):
    users = table(spark, folder, "events").select("event_id", "user_id")
    return tv.suppress_low_counts(users, "user_id", 66)


@check(
    "suppress_low_counts_text",
    """SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY text) < 2 THEN 'rare' ELSE text END AS text FROM documents""",
)
def _(spark, folder):
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return tv.suppress_low_counts(texts, "text", 2, "rare")


@check("pseudonymize_column_shuffled", SQL["pseudonymize_column_text"])
def _(spark, folder):
    """The way taken when there are too many values to broadcast."""
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return tv.pseudonymize_column(texts, "text", prefix="Doc", seed=7, broadcast_rows=0)


@check(
    "suppress_low_counts_shuffled",
    """SELECT l_orderkey, l_linenumber, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) < 3 THEN '[SUPPRESSED]'
       ELSE CAST(l_orderkey AS VARCHAR) END AS shown FROM lineitem""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("shown"))
    return tv.suppress_low_counts(lines, "shown", 3, broadcast_rows=0)
