"""Profiles, detection and automatic protection."""

from __future__ import annotations

from pyspark.sql import functions as F

import tidyveil as tv
from checks.registry import check, table
from tidyveil.constants import CATEGORY_LABELS, NAME_RULES, VALUE_RULES
from tidyveil.inspection import value_pattern_rates

# Columns made from customer alike in Spark and in the database: name -> (Spark, SQL)
_KEY9 = "lpad(CAST(c_custkey AS {t}), 9, '0')"
_CUT = "substr({k}, 1, 3) || '-' || substr({k}, 4, 2) || '-' || substr({k}, 6, 4)"
_PEOPLE = {
    "ref": "c_custkey",
    "contact": "CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(replace(c_name, '#', '.')) || '@example.com' ELSE 'none' END",
    "line": f"CASE WHEN c_mktsegment <> 'MACHINERY' THEN '+1 555 ' || {_KEY9} END",
    "code": _CUT.format(k=_KEY9),
    "card": f"'4000-1234-' || substr({_KEY9}, 1, 4) || '-' || substr({_KEY9}, 5, 4)",
    "host": "'10.0.' || CAST(c_nationkey AS {t}) || '.' || CAST(c_nationkey AS {t})",
    "first_name": "c_name",
    "salary": "c_acctbal",
    "birth-date": "CAST(DATE '1950-01-01' + CAST(c_custkey / 50 AS INTEGER) AS {t})",
    "segment": "c_mktsegment",
}


def _quoted(name, mark):
    return f"{mark}{name}{mark}"


def _sql(text):
    # Whole division in both dialects
    return text.format(t="VARCHAR").replace("c_custkey / 50", "c_custkey // 50")


_PEOPLE_SQL = "(SELECT " + ", ".join(f"{_sql(x)} AS {_quoted(n, chr(34))}" for n, x in _PEOPLE.items()) + " FROM customer)"


def people(spark, folder):
    return table(spark, folder, "customer").select(
        *[
            F.expr(x.format(t="STRING").replace("c_custkey / 50", "c_custkey div 50")).alias(n)
            for n, x in _PEOPLE.items()
        ]
    )


def _rates_sql(source, columns):
    lines = []
    for position, column in enumerate(columns):
        text = f'trim(CAST("{column}" AS VARCHAR))'
        for category, pattern, _, _ in VALUE_RULES:
            lines.append(
                f"SELECT {position} AS position, '{column}' AS \"column\", '{category}' AS category, "
                f"count({text}) AS total, count(*) FILTER (WHERE regexp_matches({text}, '{pattern}')) AS matching FROM {source}"
            )
    return (
        'SELECT position, "column", category, total, matching, '
        "round(CASE WHEN total > 0 THEN matching / total ELSE 0 END, 6) AS rate FROM (" + " UNION ALL ".join(lines) + ")"
    )


def _detection_sql(source, columns):
    value_rules = ", ".join(f"('{c}', {i}, {m}, '{a}')" for i, (c, _, m, a) in enumerate(VALUE_RULES, start=1))
    name_rules = ", ".join(f"('{p}', '{c}', {m}, '{a}', {i})" for i, (p, c, m, a) in enumerate(NAME_RULES))
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(columns))
    labels = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_LABELS.items()) + " END"
    return f"""
    WITH rates AS ({_rates_sql(source, columns)}),
    evidence AS (
        SELECT "column", category, CAST(least(CAST(matching AS DOUBLE) / total * m, 0.99) AS DOUBLE) AS confidence,
               CAST(CAST(round(100.0 * matching / total) AS BIGINT) AS VARCHAR) || '% of values match ' || category || ' pattern' AS reason,
               a AS suggested_action, 100 + t AS turn
        FROM rates JOIN (VALUES {value_rules}) v(c, t, m, a) ON c = category
        WHERE total > 0 AND matching * 2 >= total
        UNION ALL
        SELECT n."column", r.c, CAST(r.m AS DOUBLE), 'Column name matches ''' || r.c || ''' pattern', r.a, r.i
        FROM (VALUES {names}) n(i, "column"), (VALUES {name_rules}) r(p, c, m, a, i)
        WHERE regexp_matches(n."column", r.p)),
    best AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY confidence DESC, turn) AS n FROM evidence)
    SELECT "column", category, {labels} AS category_label, round(confidence, 6) AS confidence,
           CASE WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_label,
           reason, suggested_action
    FROM best WHERE n = 1 AND confidence >= 0.3"""


def _profile_sql(name, columns):
    lines = [
        f"SELECT {i} AS position, '{c}' AS \"column\", '{d}' AS dtype, '{k}' AS kind, count(*) AS total, "
        f'count(*) - count("{c}") AS missing, count(DISTINCT "{c}") AS "unique" FROM {name}'
        for i, (c, d, k) in enumerate(columns)
    ]
    return " UNION ALL ".join(lines)


@check(
    "profile_columns",
    _profile_sql(
        "(SELECT event_id, ts, event_type = 'error' AS failed, CASE WHEN event_type <> 'error' THEN value END AS value, props FROM events)",
        [("event_id", "bigint", "Number"), ("ts", "timestamp_ntz", "Date"), ("failed", "boolean", "Yes/No"),
         ("value", "double", "Number"), ("props", "string", "Text")],
    ),
)
def _(spark, folder):
    failed = F.col("event_type") == "error"
    gapped = table(spark, folder, "events").select(
        "event_id",
        "ts",
        failed.alias("failed"),
        F.when(failed, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        "props",
    )
    return tv.profile_columns(gapped)


@check(
    "profile_columns_documents",
    _profile_sql(
        "documents",
        [("doc_id", "bigint", "Number"), ("text", "string", "Text"), ("lang", "string", "Text"),
         ("source", "string", "Text"), ("n_chars", "bigint", "Number")],
    ),
)
def _(spark, folder):
    return tv.profile_columns(table(spark, folder, "documents"))


@check("value_pattern_rates", _rates_sql(_PEOPLE_SQL, _PEOPLE))
def _(spark, folder):
    return value_pattern_rates(people(spark, folder)).withColumn("rate", F.round("rate", 6))


@check("detect_sensitive_columns", _detection_sql(_PEOPLE_SQL, _PEOPLE))
def _(spark, folder):
    return tv.detect_sensitive_columns(people(spark, folder)).withColumn("confidence", F.round("confidence", 6))


@check("detect_sensitive_columns_events", _detection_sql("events", ["event_id", "ts", "user_id", "event_type", "value", "props"]))
def _(spark, folder):
    return tv.detect_sensitive_columns(table(spark, folder, "events")).withColumn("confidence", F.round("confidence", 6))


_TAIL = "CASE WHEN length({c}) <= 4 THEN repeat('*', length({c})) ELSE repeat('*', length({c}) - 4) || right({c}, 4) END"


@check(
    "auto_protect",
    f"""WITH p AS {_PEOPLE_SQL},
        names AS (SELECT k, 'ENTITY_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS label
                  FROM (SELECT k, row_number() OVER (ORDER BY md5('42:' || k), k) AS n FROM (SELECT DISTINCT first_name AS k FROM p)))
        SELECT ref, {_TAIL.format(c='contact')} AS contact, {_TAIL.format(c='line')} AS line, sha256(code) AS code,
               '[REDACTED]' AS card, label AS first_name, salary, left("birth-date", 4) AS "birth-date", segment
        FROM p JOIN names ON k = first_name""",
)
def _(spark, folder):
    return tv.auto_protect(people(spark, folder), {"host": "remove", "salary": "skip"})


@check(
    "detect_with_examples",
    "SELECT 'contact' AS \"column\", 'email' AS category, list(mail ORDER BY mail) AS sample_matches FROM "
    "(SELECT DISTINCT 'user' || c_custkey || '@example.com' AS mail FROM customer WHERE c_custkey > (SELECT max(c_custkey) / 2 FROM customer) ORDER BY mail LIMIT 5)",
)
def _(spark, folder):
    """A column whose first half is empty."""
    customer = table(spark, folder, "customer")
    half = customer.agg(F.max("c_custkey") / 2).scalar()
    mail = F.when(F.col("c_custkey") > half, F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@example.com")))
    found = tv.detect_sensitive_columns(customer.select(mail.alias("contact"), "c_nationkey"), with_examples=True)
    return found.select("column", "category", "sample_matches")
