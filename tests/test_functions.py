"""Text of numbers, dates, numbers and truth values, one by one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.errors import StepError
from tidyveil.functions.columns import as_text, is_blank, squeeze, strip, to_number
from tidyveil.functions.parsing import parse_boolean, parse_moment, spark_date_pattern, with_moment, with_number
from tidyveil.functions.patterns import java_pattern, java_replacement


def evaluate(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def whole(spark, values, kind, operator):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["v"] for r in operator(df, "v").orderBy("i").collect()]


def test_doubles_read_as_python_writes_them(spark):
    values = [1.0, 0.0, -0.5, 1e7, 12345678.9, 0.00012, -2.5e9, 1e16, 1.5e-7, 1.2345678901234568e17, 1e22, 9999999.5, 0.001, 1e-5]
    assert evaluate(spark, values, "double", lambda c: as_text(c, T.DoubleType())) == [str(v) for v in values]


def test_text_of_other_types(spark):
    assert evaluate(spark, [True, False, None], "boolean", lambda c: as_text(c, T.BooleanType())) == ["True", "False", None]
    assert evaluate(spark, [float("nan")], "double", lambda c: as_text(c, T.DoubleType())) == [None]
    assert evaluate(spark, [12], "int", lambda c: as_text(c, T.IntegerType())) == ["12"]


def test_white_space(spark):
    values = ["  a   b\t\nc ", "\xa0x　", "\x1cy\x1f", "   ", "", None, "p\xa0q"]
    assert evaluate(spark, values, "string", squeeze) == ["a b c", "x", "y", "", "", None, "p q"]
    assert evaluate(spark, values, "string", strip) == ["a   b\t\nc", "x", "y", "", "", None, "p\xa0q"]
    blank = evaluate(spark, values, "string", lambda c: is_blank(c, T.StringType()))
    assert blank == [False, False, False, True, True, True, False]


DATES = {
    "01/15/1990": "1990-01-15",
    "1985-03-22": "1985-03-22",
    "22-07-1992": "1992-07-22",
    "Mar 5, 1988": "1988-03-05",
    "1995.11.30": "1995-11-30",
    "June 3, 1987": "1987-06-03",
    "07-04-1994": "1994-07-04",
    "25-Mar-2026": "2026-03-25",
    "5 March 2024": "2024-03-05",
    "1/5/24": "2024-01-05",
    "31/12/99": "1999-12-31",
    "20240115": "2024-01-15",
    " Sept 5th, 2023 ": "2023-09-05",
    "2024-13-45": None,
    "2024-02-30": None,
    "99/99/2024": None,
    "Mayor 5, 2020": None,
    "85000": None,
    "12:30": None,
    "": None,
}
MOMENTS = {
    "2024-01-15T10:30:00Z": dt.datetime(2024, 1, 15, 10, 30),
    "2024-01-15 10:30:00.25+02:00": dt.datetime(2024, 1, 15, 10, 30, 0, 250_000),
    "01/15/2024 3:30 PM": dt.datetime(2024, 1, 15, 15, 30),
    "1/5/2024 3:04:05 am": dt.datetime(2024, 1, 5, 3, 4, 5),
    "1/5/2024 12:10 am": dt.datetime(2024, 1, 5, 0, 10),
    "1/5/2024 12:10 PM": dt.datetime(2024, 1, 5, 12, 10),
    "1/5/2024 15:10 PM": None,
    "March 5 2021 10:11": dt.datetime(2021, 3, 5, 10, 11),
}


def test_date_styles(spark):
    got = whole(spark, list(DATES), "string", with_moment)
    assert [str(v.date()) if v else None for v in got] == list(DATES.values())


def test_times_of_day(spark):
    assert evaluate(spark, list(MOMENTS), "string", parse_moment) == list(MOMENTS.values())


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = evaluate(spark, ["03/10/2024 2:30 AM", "2024-03-10 02:30:00"], "string", lambda c: parse_moment(c).cast("string"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-03-10 02:30:00"] * 2


def test_date_patterns():
    assert spark_date_pattern("%Y-%m-%d") == "yyyy-MM-dd"
    assert spark_date_pattern("%d of %B, %Y at %H:%M") == "dd' of 'MMMM, yyyy' at 'HH:mm"
    assert spark_date_pattern("100%%") == "100%"
    with pytest.raises(StepError):
        spark_date_pattern("%Q")


NUMBERS = {
    "$1,234.56": 1234.56, "€ 1.234,56": 1234.56, "1 234.56": 1234.56, "(100)": -100.0, "(50)%": None, "(50%)": -0.5,
    "1.234": 1234.0, "€ 89,50": 8950.0, "12.5%": 0.125, "  $95,000  ": 95000.0, "¥8,500,000": 8500000.0, "abc": None,
    "": None, "1e3": 1000.0, "12d": None, "1_000": None, "inf": None, "nan": None, "-5": -5.0, "(1.234,5)": -1234.5,
    ".5": 0.5, "5.": 5.0, "()": None, "%": None, "($1,000)": -1000.0,
}


def test_numbers(spark):
    assert whole(spark, list(NUMBERS), "string", with_number) == list(NUMBERS.values())
    assert whole(spark, [3, None], "int", with_number) == [3.0, None]


def test_plain_numbers(spark):
    got = evaluate(spark, [" 12 ", "1e2", "12f", "x", None], "string", lambda c: to_number(c, T.StringType()))
    assert got == [12.0, 100.0, None, None, None]


def test_booleans(spark):
    words = ["Yes", " y ", "TRUE", "1", "1.0", "on", "Active", "No", "0.0", "inactive", "off", "maybe", "", None]
    got = evaluate(spark, words, "string", lambda c: parse_boolean(c, T.StringType()))
    assert got == [True] * 7 + [False] * 4 + [None] * 3
    assert evaluate(spark, [1, 0, 2], "int", lambda c: parse_boolean(c, T.IntegerType())) == [True, False, None]
    assert evaluate(spark, [1.0, 0.0], "double", lambda c: parse_boolean(c, T.DoubleType())) == [True, False]


def test_patterns_between_dialects():
    assert java_pattern(r"(?P<a>x)(?P=a)") == r"(?<a>x)\k<a>"
    assert java_replacement(r"$\1-\g<2>-\g<name>\\") == r"\$$1-$2-${name}\\"
    with pytest.raises(StepError):
        java_pattern("(")
