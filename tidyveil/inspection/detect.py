"""Finding columns that look sensitive, by their name and by the shape of their values."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.constants import (
    CATEGORY_LABELS,
    CONFIDENCE_CEILING,
    CONFIDENCE_NEEDED,
    HIGH_CONFIDENCE,
    MEDIUM_CONFIDENCE,
    NAME_RULES,
    VALUE_RATE_NEEDED,
    VALUE_RULES,
)
from tidyveil.functions.columns import as_text, is_nested, is_temporal, ref, sql_text, strip

# What a text must have before its pattern is worth trying: cheap tests that follow from the patterns.
_WORTH_TRYING = {
    "email": "contains({t}, '@')",
    "phone": "char_length({t}) BETWEEN 7 AND 19",
    "ssn": "char_length({t}) BETWEEN 9 AND 11",
    "credit_card": "char_length({t}) BETWEEN 16 AND 19",
    "ip_address": "char_length({t}) BETWEEN 7 AND 15",
}
_RATE_SCHEMA = "position int, column string, category string, total bigint, matching bigint, rate double"
_DETECTION_SCHEMA = (
    "position int, column string, category string, confidence double, reason string, suggested_action string"
)
EXAMPLES = 5


def name_matches(columns: list[str]) -> list[tuple[int, str, str, float, str, str]]:
    """(position, column, category, confidence, reason, action): each name's best rule, if any fits."""
    found = []
    for position, column in enumerate(columns):
        fitting = [rule for rule in NAME_RULES if re.search(rule[0], column)]
        if fitting:
            _, category, confidence, action = max(fitting, key=lambda rule: rule[2])
            reason = f"Column name matches '{category}' pattern"
            found.append((position, column, category, confidence, reason, action))
    return found


def _scannable(df: DataFrame, skip_numeric_and_dates: bool) -> list[tuple[int, T.StructField]]:
    def wanted(dtype: T.DataType) -> bool:
        if is_nested(dtype):
            return False
        return not (skip_numeric_and_dates and (isinstance(dtype, T.NumericType) or is_temporal(dtype)))

    return [(i, f) for i, f in enumerate(df.schema.fields) if wanted(f.dataType)]


def _stripped_text(field: T.StructField) -> Column:
    text = as_text(ref(field.name), field.dataType)
    return strip(text) if isinstance(field.dataType, T.StringType) else text


def value_pattern_rates(df: DataFrame, skip_numeric_and_dates: bool = False) -> DataFrame:
    """(position, column, category, total, matching, rate) for every flat column and value pattern.

    One aggregate over the whole table.
    """
    fields = _scannable(df, skip_numeric_and_dates)
    if not fields:
        return df.sparkSession.createDataFrame([], _RATE_SCHEMA)
    texts = df.select(*[_stripped_text(f).alias(f"t{i}") for i, f in fields])
    figures, lines = [], []  # as SQL text: one expression to parse instead of thousands of calls
    for i, f in fields:
        figures.append(F.expr(f"count(t{i})").alias(f"n{i}"))
        for category, pattern, _, _ in VALUE_RULES:
            fits = f"{_WORTH_TRYING[category].format(t=f't{i}')} AND t{i} RLIKE {sql_text(pattern)}"
            figures.append(F.expr(f"count_if({fits})").alias(f"n{i}_{category}"))
            lines.append(
                f"struct({i} AS position, {sql_text(f.name)} AS column, '{category}' AS category, n{i} AS total, "
                f"n{i}_{category} AS matching, coalesce(try_divide(n{i}_{category}, n{i}), 0D) AS rate)"
            )
    return texts.agg(*figures).select(F.expr(f"inline(array({', '.join(lines)}))"))


def _examples(df: DataFrame, found: DataFrame) -> DataFrame:
    """(column, category, sample_matches): the five least matching values of each detected column and category.

    A top-k over the whole table for each pair; there is at most one pair for each column.
    """
    fields, patterns = {f.name: f for f in df.schema.fields}, {rule[0]: rule[1] for rule in VALUE_RULES}
    parts = []
    for row in found.filter("turn > 0").select("column", "category").collect():
        field = fields[row["column"]]
        text = as_text(ref(field.name), field.dataType)
        worth = F.expr(_WORTH_TRYING[row["category"]].format(t="s"))
        hits = df.select(text.alias("t"), strip(text).alias("s")).filter(worth & F.col("s").rlike(patterns[row["category"]])).select("t").distinct()
        parts.append(
            hits.orderBy("t").limit(EXAMPLES).agg(F.sort_array(F.collect_list("t")).alias("sample_matches"))
            .select(F.lit(row["column"]).alias("column"), F.lit(row["category"]).alias("category"), "sample_matches")
        )
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, category string, sample_matches array<string>")
    return reduce(lambda a, b: a.unionByName(b), parts)


def detect_sensitive_columns(
    df: DataFrame,
    min_confidence: float = CONFIDENCE_NEEDED,
    skip_numeric_and_dates: bool = False,
    with_examples: bool = False,
) -> DataFrame:
    """One row per column that looks sensitive, most certain first.

    Columns: column, category, category_label, confidence, confidence_label, reason,
    suggested_action, and with ``with_examples`` also sample_matches (raw values: handle with care).
    A column's best evidence counts, the earlier rule on a tie. Values are judged over the whole
    table, and examples are its least matching values, each once.
    """
    spark = df.sparkSession
    by_name = spark.createDataFrame(name_matches(df.columns), _DETECTION_SCHEMA).withColumn("turn", F.lit(0))
    rules = ", ".join(
        f"'{category}', struct({turn} AS turn, {highest}D AS highest, '{action}' AS action)"
        for turn, (category, _, highest, action) in enumerate(VALUE_RULES, start=1)
    )
    rule = F.expr(f"element_at(map({rules}), category)")
    by_value = (
        value_pattern_rates(df, skip_numeric_and_dates)
        .filter(F.col("rate") >= VALUE_RATE_NEEDED)
        .select(
            "position",
            "column",
            "category",
            F.least(F.col("rate") * rule.getField("highest"), F.lit(CONFIDENCE_CEILING)).alias("confidence"),
            F.format_string("%.0f%% of values match %s pattern", F.col("rate") * 100, F.col("category")).alias("reason"),
            rule.getField("action").alias("suggested_action"),
            rule.getField("turn").alias("turn"),
        )
    )
    evidence = by_name.unionByName(by_value)
    best = (
        evidence.groupBy("position")
        .agg(F.max_by(F.struct(*evidence.columns), F.struct(F.col("confidence"), -F.col("turn"))).alias("best"))
        .select("best.*")
        .filter(F.col("confidence") >= min_confidence)
    )
    labels = ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in CATEGORY_LABELS.items())
    result = best.select(
        "position",
        "column",
        "category",
        F.expr(f"element_at(map({labels}), category)").alias("category_label"),
        "confidence",
        F.when(F.col("confidence") >= HIGH_CONFIDENCE, "High")
        .when(F.col("confidence") >= MEDIUM_CONFIDENCE, "Medium")
        .otherwise("Low")
        .alias("confidence_label"),
        "reason",
        "suggested_action",
        "turn",
    )
    shown = ["column", "category", "category_label", "confidence", "confidence_label", "reason", "suggested_action"]
    if with_examples:
        examples = _examples(df, result)
        none = F.array().cast("array<string>")
        result = result.join(examples, ["column", "category"], "left").withColumn("sample_matches", F.coalesce("sample_matches", none))
        shown.append("sample_matches")
    return result.orderBy(F.col("confidence").desc(), "position").select(*shown)
