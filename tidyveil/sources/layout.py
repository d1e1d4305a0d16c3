"""Guessing delimiter, header row and encoding of delimited files, one job for any number of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyveil.constants import DELIMITERS, HEADER_SCAN_ROWS, HEADER_SCORE_NEEDED, MISSING_TOKENS
from tidyveil.functions.columns import PLAIN_NUMBER, strip
from tidyveil.functions.parsing import parse_moment
from tidyveil.sources.lines import as_latin1, file_encodings, head_lines, numbered_lines

_UNQUOTED = {d: ("\\" + d if d == "|" else d) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)' for d in DELIMITERS}


def _delimiters(heads: DataFrame) -> DataFrame:
    """(file, delimiter): the sign that cuts most lines into the same number of cells."""
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counts = F.array(
        *[
            F.struct(
                F.lit(turn).alias("turn"),
                F.lit(d).alias("delimiter"),
                (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("signs"),
            )
            for turn, d in enumerate(DELIMITERS)
        ]
    )
    tallied = (
        heads.select("file", F.inline(counts))
        .groupBy("file", "turn", "delimiter", "signs")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    even = (
        tallied.filter("signs > 0")
        .groupBy("file")
        .agg(
            F.max(F.struct("lines", "signs", (-F.col("turn")).alias("turn"), "delimiter")).alias("best"),
        )
    )
    totals = heads.groupBy("file").agg(F.count(F.lit(1)).alias("head"))
    return (
        totals.join(even, "file", "left")
        .select("file", F.when(F.col("best.lines") * 2 >= F.col("head"), F.col("best.delimiter")).alias("delimiter"))
    )


def _cells(value: Column, delimiter: Column) -> Column:
    pieces = reduce(
        lambda chain, d: chain.when(delimiter == d, F.split(value, _UNQUOTED[d])),
        DELIMITERS[1:],
        F.when(delimiter == DELIMITERS[0], F.split(value, _UNQUOTED[DELIMITERS[0]])),
    )
    bare = F.transform(pieces, lambda c: strip(F.regexp_replace(strip(c), '^"|"$', "")))
    return F.filter(bare, lambda c: ~c.isin(*MISSING_TOKENS))


def _header_score(cells: Column) -> Column:
    """How much a row of cells looks like column names: words score, numbers and repeats cost."""
    folded = F.transform(cells, lambda c: F.lower(c))

    def score(cell: Column, at: Column) -> Column:
        repeat = F.when(F.array_position(folded, F.lower(cell)) < at + 1, -0.5).otherwise(0.0)
        number = F.regexp_replace(cell, "[,%]", "")
        numeric = number.rlike(PLAIN_NUMBER) | number.rlike(r"(?i)^[+-]?(nan|inf|infinity)$")
        parted = cell.rlike("-.*-") | cell.rlike("/.*/")
        dated = parted & parse_moment(cell).isNotNull()
        words = F.when(cell.rlike(r"[ _-]"), 1.4).otherwise(1.2)
        kind = (
            F.when(numeric | dated, -0.8)
            .when(F.lower(cell).startswith("unnamed"), -1.0)
            .when(cell.rlike(r"\p{L}"), words)
            .otherwise(-0.3)
        )
        return repeat + kind

    total = F.aggregate(F.transform(cells, score), F.lit(0.0).cast("double"), lambda a, b: a + b.cast("double"))
    return F.when(F.size(cells) < 2, F.lit(0.0)).otherwise(F.round(total, 6))


def detect_layout(spark: SparkSession, paths: str | list[str], scan_rows: int = HEADER_SCAN_ROWS) -> DataFrame:
    """(file, header_row, delimiter, is_utf8), one row per file.

    ``header_row`` counts lines that are not blank, from 0: the one among the first ``scan_rows``
    that looks most like column names, 0 if none does. ``delimiter`` is NULL if no sign cuts the
    lines evenly. ``is_utf8`` looks at every line; files where it is false are Latin-1.
    """
    lines = numbered_lines(spark, paths)
    heads = head_lines(lines, scan_rows).withColumn(
        "value", F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(as_latin1())
    )
    delimiters = _delimiters(heads)
    usual = F.when(F.lower("file").endswith(".csv"), ",").otherwise("\t")
    scored = heads.join(delimiters, "file").select(
        "file", "row", _header_score(_cells(F.col("value"), F.coalesce("delimiter", usual))).alias("score")
    )
    best = scored.groupBy("file").agg(
        F.max_by(F.struct("row", "score"), F.struct(F.col("score"), -F.col("row"))).alias("best")
    )
    rows = best.select(
        "file",
        F.when(F.col("best.score") >= HEADER_SCORE_NEEDED, F.col("best.row")).otherwise(0).cast("int").alias("header_row"),
    )
    return rows.join(delimiters, "file").join(file_encodings(lines), "file").select(
        "file", "header_row", "delimiter", "is_utf8"
    )
