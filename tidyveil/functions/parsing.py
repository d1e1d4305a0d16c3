"""Mixed date, number and truth-value spellings, read with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.constants import (
    CURRENCY_SIGNS,
    FALSE_WORDS,
    GROUPED_BY_DOTS,
    STRFTIME_TO_SPARK,
    TRUE_WORDS,
)
from tidyveil.errors import StepError
from tidyveil.functions.columns import (
    PLAIN_NUMBER,
    SPACE_CLASS,
    as_text,
    is_temporal,
    need_flat,
    ref,
    replace_column,
    strip,
)

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
)
_NTH = r"(\d{1,2})(?:st|nd|rd|th)?"
_REST = r"(?:[T ]\s*(.*))?$"
_PAIR = r"^(\d{1,2})[-./](\d{1,2})[-./]"

# Shapes of dates: pattern, then its parts put as year-month-day with the rest behind a space.
_DIGIT_SHAPES = (
    (r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})" + _REST, "$1-$2-$3 $4"),
    (_PAIR + r"(\d{4}|\d{2})" + _REST, "$3-$1-$2 $4"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
)
_DAY_FIRST = (_DIGIT_SHAPES[1][0], "$3-$2-$1 $4")
_WORD_SHAPES = (
    r"(?i)^" + _MONTH + r"[ -]" + _NTH + r"[, -]+(\d{4}|\d{2})" + _REST,
    r"(?i)^" + _NTH + r"[ -]" + _MONTH + r"[, -]+(\d{4}|\d{2})" + _REST,
)
_THIS_CENTURY = r"^(?=(?:[0-5]\d|6[0-8])-)"  # two-digit years: 00 to 68 are 20xx, 69 to 99 are 19xx
_LAST_CENTURY = r"^(?=(?:69|[7-9]\d)-)"


def _as_moment(date: Column) -> Column:
    full = F.regexp_replace(F.regexp_replace(F.trim(date), _THIS_CENTURY, "20"), _LAST_CENTURY, "19")
    return full.try_cast("timestamp_ntz")


def parse_moment(text: Column) -> Column:
    """Stripped text in any of the known date styles as a wall-clock timestamp, else NULL.

    The first shape that fits the text rewrites it as year-month-day, and one cast reads that.
    Digits alone are month first; where that is no date, day first.
    """
    half_day = F.lower(F.right(text, F.lit(2))).isin("am", "pm") & text.contains(":")
    body = F.when(half_day, F.trim(F.substring(text, F.lit(1), F.length(text) - 2))).otherwise(text)
    month = F.lower(F.regexp_extract(text, r"(?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec", 0))
    number = ((F.instr(F.lit(_MONTHS), month) + 2) / 3).cast("int").cast("string")

    date = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, put in _DIGIT_SHAPES:
        date = date.when(body.rlike(pattern), F.regexp_replace(body, pattern, put))
    for pattern in _WORD_SHAPES:
        words = F.concat(F.regexp_replace(body, pattern, "$2-"), number, F.regexp_replace(body, pattern, "-$1 $3"))
        date = date.when(body.rlike(pattern), words)
    other = F.when(body.rlike(_DAY_FIRST[0]), F.regexp_replace(body, *_DAY_FIRST))

    hour = F.regexp_extract(text, r"(\d{1,2}):", 1).try_cast("int")
    pm = F.lower(F.right(text, F.lit(2))) == "pm"
    shift = F.when(hour <= 12, F.when(pm & (hour < 12), 12).when(~pm & (hour == 12), -12).otherwise(0))
    moved = F.make_dt_interval(F.lit(0), F.when(half_day, shift).otherwise(0))
    return F.coalesce(_as_moment(date), _as_moment(other)) + moved


def with_moment(df: DataFrame, column: str) -> DataFrame:
    """``column`` read as a timestamp; left alone where it is a date or timestamp already."""
    dtype = need_flat(df, column)
    if is_temporal(dtype):
        return df
    # Stripped in a projection of its own, so that once a row is enough.
    text = replace_column(df, column, strip(as_text(ref(column), dtype)))
    return replace_column(text, column, parse_moment(ref(column)))


def spark_date_pattern(strftime: str) -> str:
    """A strftime pattern as a Spark datetime pattern."""
    out, literal, i = [], "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            letters = any(ch.isalpha() or ch in "[]{}#'" for ch in literal)
            out.append("'" + literal.replace("'", "''") + "'" if letters else literal)
            literal = ""

    while i < len(strftime):
        ch = strftime[i]
        if ch != "%":
            literal += ch
            i += 1
            continue
        code = strftime[i + 1 : i + 2]
        i += 2
        if code == "%":
            literal += "%"
        elif code in STRFTIME_TO_SPARK:
            flush()
            out.append(STRFTIME_TO_SPARK[code])
        else:
            raise StepError(f"date format code %{code} is not supported")
    flush()
    return "".join(out)


def with_number(df: DataFrame, column: str) -> DataFrame:
    """``column`` read as a double: ``$1,234.50``, ``(500)``, ``12.5%``, dot-grouped ``1.234,56``; else NULL.

    One projection per stage: each stage uses its input several times, and has it computed once.
    """
    dtype, c, negative = need_flat(df, column), ref(column), F.col("__negative")
    text = replace_column(df, column, strip(as_text(c, dtype)))
    text = text.withColumn("__negative", c.startswith("(") & c.endswith(")") & (F.length(c) > 1))

    inner = F.when(negative, F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    bare = replace_column(text, column, F.regexp_replace(inner, f"[{CURRENCY_SIGNS}{SPACE_CLASS}]", ""))

    no_dots, no_commas = F.replace(c, F.lit("."), F.lit("")), F.replace(c, F.lit(","), F.lit(""))
    pointed = F.when(c.rlike(GROUPED_BY_DOTS), F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas)
    plain = replace_column(bare, column, pointed)

    per_cent = c.endswith("%")
    digits = F.when(per_cent, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    number = F.when(digits.rlike(PLAIN_NUMBER), digits.try_cast("double"))
    sign = F.when(negative, -1.0).otherwise(1.0)
    result = number * sign / F.when(per_cent, 100.0).otherwise(1.0)
    return replace_column(plain, column, result).drop("__negative")


def parse_boolean(c: Column, dtype: T.DataType) -> Column:
    """Common yes / no spellings as a boolean, anything else NULL."""
    word = F.lower(strip(as_text(c, dtype)))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)

