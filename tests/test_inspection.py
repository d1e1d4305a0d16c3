"""Profiles, detection, protection."""

import pytest
from pyspark.sql import functions as F

import tidyveil as tv
from tidyveil.errors import StepError
from tidyveil.inspection import name_matches, protection_steps, value_pattern_rates


@pytest.fixture(scope="module")
def staff(spark):
    rows = [(i, f"Name{i}", f"p{i}@example.com", f"(555) 010-{i:04d}", 1000 * i, "Eng" if i % 2 else "Ops") for i in range(1, 8)]
    return spark.createDataFrame(rows, "employee_id int, first_name string, contact string, line string, salary int, dept string")


def test_names():
    found = {r[1]: r[2] for r in name_matches(["email", "E-Mail", "phone_number", "Full Name", "full_name", "name", "Name", "salary_usd", "salary", "ip_address", "api_key"])}
    assert found == {
        "email": "email", "E-Mail": "email", "full_name": "name", "name": "name", "Name": "name",
        "salary": "financial", "ip_address": "ip_address", "api_key": "credential",
    }


def test_detection(staff):
    found = [tuple(r) for r in tv.detect_sensitive_columns(staff).select("column", "category", "suggested_action", "confidence_label").collect()]
    assert found == [
        ("contact", "email", "mask", "High"),
        ("first_name", "name", "pseudonymize", "High"),
        ("salary", "financial", "mask", "High"),
        ("employee_id", "identifier", "hash", "Medium"),
        ("line", "phone", "mask", "Medium"),
    ]
    assert tv.detect_sensitive_columns(staff, min_confidence=0.85).count() == 1


def test_examples_come_only_on_request(staff):
    shown = tv.detect_sensitive_columns(staff, with_examples=True).collect()
    by_column = {r["column"]: r["sample_matches"] for r in shown}
    assert len(by_column["contact"]) == 5 and by_column["first_name"] == []


def test_nothing_to_find(spark):
    clean = spark.createDataFrame([(1, "a", 3), (2, "b", 4)], "product int, category string, quantity int")
    assert tv.detect_sensitive_columns(clean).count() == 0
    assert tv.detect_sensitive_columns(clean.filter("false")).count() == 0
    nested = spark.sql("SELECT array(1) AS a")
    assert value_pattern_rates(nested).count() == 0
    assert tv.detect_sensitive_columns(nested, with_examples=True).count() == 0


def test_type_guard(spark):
    long = spark.createDataFrame([(12345678,)], "serial bigint")
    assert tv.detect_sensitive_columns(long).first()["category"] == "phone"
    assert tv.detect_sensitive_columns(long, skip_numeric_and_dates=True).count() == 0


def test_protection(staff):
    safe = tv.auto_protect(staff, {"line": "remove", "salary": "generalize", "dept": "redact"})
    assert safe.columns == ["employee_id", "first_name", "contact", "salary", "dept"]
    row = safe.orderBy("contact").first()
    assert row["dept"] == "[REDACTED]" and row["first_name"].startswith("ENTITY_") and len(row["employee_id"]) == 64
    assert row["contact"].endswith(".com") and row["contact"].startswith("****")
    assert [s.transform_type for s in protection_steps(staff, {c: "skip" for c in staff.columns})] == []
    for bad in ({"dept": "burn"}, {"nobody": "mask"}):
        with pytest.raises(StepError):
            tv.auto_protect(staff, bad)


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (1, None, 2.0)], "n int, t string, d double").selectExpr("*", "map('k', 1) AS m")
    lines = {r["column"]: (r["kind"], r["total"], r["missing"], r["unique"]) for r in tv.profile_columns(df).collect()}
    assert lines == {"n": ("Number", 2, 0, 1), "t": ("Text", 2, 1, 1), "d": ("Number", 2, 1, 1), "m": ("Text", 2, 0, None)}
    assert {r["column"]: r["unique"] for r in tv.profile_columns(df.drop("m"), approx=True).collect()} == {"n": 1, "t": 1, "d": 1}
    assert tv.profile_columns(df.select()).count() == 0


def test_profile_tells_values_apart(spark):
    """Zeros, long texts that differ at their end, texts that look like digests, nested cells."""
    import hashlib

    long = "x" * 100
    rows = [(0.0, long + "a", "=1", [1, None]), (-0.0, long + "b", "1", [1]), (float("nan"), hashlib.sha256((long + "a").encode()).hexdigest(), None, [1, None]), (1.5, long + "a", "1", None)]
    df = spark.createDataFrame(rows, "d double, t string, s string, a array<int>").withColumn("b", F.col("s").cast("binary"))
    found = {r["column"]: (r["total"], r["missing"], r["unique"]) for r in tv.profile_columns(df).collect()}
    assert found == {"d": (4, 1, 2), "t": (4, 0, 3), "s": (4, 1, 2), "a": (4, 1, 2), "b": (4, 1, 2)}
    assert [(r["total"], r["missing"], r["unique"]) for r in tv.profile_columns(df.limit(0)).collect()] == [(0, 0, 0)] * 5
