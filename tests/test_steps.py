"""Specs, runs, figures, streams."""

import json

import pytest
from pyspark.sql import functions as F

import tidyveil as tv
from tidyveil.errors import SpecError, StepError
from tidyveil.plans import runner
from tidyveil.plans.steps import Step
from tidyveil.streaming import batch_only_steps


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, " Ada ", "a@x.com", "$10", None), (2, "Ada", "a@x.com", "$10", None), (3, "Bo", None, "(5)", None)]
    return spark.createDataFrame(rows, "id int, name string, email string, pay string, nothing string")


def spec(**changes):
    return {"schema_version": 1, "steps": [{"transform_type": "TRIM_WHITESPACE"}]} | changes


@pytest.mark.parametrize(
    "document",
    [
        [], "not json", "[1]", spec(steps=None), spec(steps={}), spec(steps=[]), spec(steps=["x"]), spec(schema_version=2),
        spec(schema_version="1"), spec(steps=[{"transform_type": "BURN"}]), spec(steps=[{"params": {}}]),
        spec(steps=[{"transform_type": "MASK_COLUMN", "params": {}}]),
        spec(steps=[{"transform_type": "MASK_COLUMN", "params": {"column": 3}}]),
        spec(steps=[{"transform_type": "MASK_COLUMN", "params": "x"}]),
        spec(steps=[{"transform_type": "REMOVE_COLUMNS", "params": {"columns": "a"}}]),
        spec(steps=[{"transform_type": "TRIM_WHITESPACE", "enabled": 1}]),
    ],
)
def test_bad_specs(document):
    if document == []:
        assert tv.load_steps(document) == []
        return
    with pytest.raises(SpecError):
        tv.load_steps(document)


def test_spec_round_trip():
    steps = [Step("MASK_COLUMN", {"column": "é", "show_last": 2}), Step("TRIM_WHITESPACE", enabled=False)]
    text = tv.dump_steps(steps, "n", "d")
    assert tv.load_steps(text) == steps
    assert json.loads(text)["name"] == "n" and "é" in text
    assert tv.spec_issues({"schema_version": None, "steps": [{"transform_type": "TRIM_WHITESPACE", "params": None}]}) == []


def test_run_and_metrics(table):
    steps = [
        Step("TRIM_WHITESPACE"),
        Step("REMOVE_EMPTY_COLUMNS"),
        Step("REMOVE_DUPLICATES", {"subset": ["name"]}),
        Step("NORMALIZE_NUMBERS", {"column": "pay"}),
        Step("REDACT_COLUMN", {"column": "email"}, enabled=False),
        Step("FILL_MISSING", {"column": "email", "strategy": "drop"}),
    ]
    result = tv.run_steps(table, steps, order_by=["id"])
    assert [tuple(r) for r in result.data.collect()] == [(1, "Ada", "a@x.com", 10.0)]
    lines = [(r["step_name"], r["rows_before"], r["rows_after"], r["cols_before"], r["cols_after"]) for r in result.metrics().orderBy("step").collect()]
    assert lines == [
        ("Trim Whitespace", 3, 3, 5, 5), ("Remove Empty Columns", 3, 3, 5, 4), ("Remove Duplicates", 3, 2, 4, 4),
        ("Normalize Numbers", 2, 2, 4, 4), ("Fill Missing Values", 2, 1, 4, 4),
    ]
    text = result.summary_text(1.5)
    assert "rows 3 -> 1" in text and "columns 5 -> 4" in text and "rows -1" in text
    assert tv.run_steps(table, []).metrics().count() == 0


@pytest.mark.parametrize(
    "step",
    [
        Step("MASK_COLUMN", {"column": "name", "visible_chars": 2}), Step("MASK_COLUMN", {}), Step("BURN"),
        Step("HASH_COLUMN", {"column": "name", "algorithm": "crc"}), Step("MASK_COLUMN", {"column": "gone"}),
        Step("FILTER_ROWS", {"column": "id", "operator": ">", "value": "x"}), Step("RENAME_COLUMNS", {"mapping": {"id": "name"}}),
        Step("MASK_COLUMN", {"column": "name", "show_last": "two"}), Step("FILL_MISSING", {"column": "pay", "strategy": "forward"}),
    ],
)
def test_failing_steps_stop_or_are_skipped(table, step):
    with pytest.raises((StepError, ValueError)):
        tv.run_steps(table, [step])
    if step.transform_type in ("MASK_COLUMN", "HASH_COLUMN", "BURN"):  # to go on would publish what it hides
        with pytest.raises((StepError, ValueError)):
            tv.run_steps(table, [step], on_error="skip")
        return
    result = tv.run_steps(table, [step, Step("REDACT_COLUMN", {"column": "pay"})], on_error="skip")
    assert not result.success
    assert {r["pay"] for r in result.data.collect()} == {"[REDACTED]"}
    first = result.metrics().orderBy("step").first()
    assert first["error"] and not first["success"] and first["rows_after"] == 3


def test_absent_columns_may_be_allowed(table):
    assert tv.run_steps(table, [Step("MASK_COLUMN", {"column": "gone"})], require_columns=False).success
    assert tv.run_steps(table, [Step("NORMALIZE_DATES", {"column": "gone"})]).success


def test_aliases(table):
    steps = [
        Step("REPLACE_VALUES", {"column": "name", "find": "Bo", "replace": "Cy"}),
        Step("SUPPRESS_LOW_COUNTS", {"column": "pay", "threshold": 2}),
        Step("GENERALIZE_COLUMN", {"column": "id", "round_to": 2}),
    ]
    rows = tv.run_steps(table, steps).data.orderBy("name").collect()
    assert [r["name"] for r in rows] == [" Ada ", "Ada", "Cy"] and rows[2]["pay"] == "[SUPPRESSED]"


def test_statistics_of_other_columns_are_read_from_the_source(spark):
    df = spark.range(100).selectExpr("id", *[f"IF(id % 3 = 0, NULL, CAST(id AS DOUBLE)) AS c{i}" for i in range(12)])
    steps = [Step("FILL_MISSING", {"column": f"c{i}", "strategy": "mean"}) for i in range(12)]
    result = tv.run_steps(df, steps)
    plan = result.data._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") <= 13  # one scan for the rows, at most one per statistic
    assert result.data.selectExpr(*[f"count(c{i}) AS n{i}" for i in range(12)]).first() == tuple([100] * 12)


def test_plans_that_would_scan_too_often_go_on_from_a_stored_table(spark, monkeypatch):
    monkeypatch.setattr(runner, "MAX_SCANS", 4)
    df = spark.range(60).selectExpr("id", "IF(id % 4 = 1, id, NULL) AS a", "IF(id % 5 = 1, id, NULL) AS b", "IF(id % 7 = 1, id, NULL) AS c")
    steps = []
    for c in "abc":
        steps += [Step("FILL_MISSING", {"column": c, "strategy": "forward"}), Step("FILTER_ROWS", {"column": c, "operator": ">=", "value": 0})]
    got = tv.run_steps(df, steps, order_by=["id"]).data.orderBy("id").collect()
    assert [tuple(r) for r in got][:3] == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1)] and len(got) == 59


def test_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(3).write.parquet(source)
    steps = [
        Step("FILTER_ROWS", {"column": "event_type", "operator": "!=", "value": "error"}),
        Step("HASH_COLUMN", {"column": "user_id"}),
        Step("MASK_COLUMN", {"column": "props"}),
        Step("NORMALIZE_DATES", {"column": "ts"}),
        Step("GENERALIZE_COLUMN", {"column": "value", "bins": [0, 10, 100]}),
        Step("FILL_MISSING", {"column": "value", "value": "none"}),
    ]
    stream = spark.readStream.schema(table.schema).parquet(source)
    query = (
        tv.run_steps(stream, steps).data.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start(target)
    )
    assert query.awaitTermination(120)
    assert spark.read.parquet(target).exceptAll(tv.run_steps(table, steps).data).isEmpty()
    for refused in (Step("REMOVE_DUPLICATES"), Step("PSEUDONYMIZE_COLUMN", {"column": "user_id"}), Step("GENERALIZE_COLUMN", {"column": "value"}),
                    Step("FILL_MISSING", {"column": "value", "strategy": "mean"}), Step("REMOVE_EMPTY_COLUMNS")):
        assert batch_only_steps([refused]) == [refused]
        with pytest.raises(StepError):
            tv.run_steps(stream, [refused])


def test_privacy_steps_never_show_the_value(spark):
    df = spark.range(50).select(F.concat(F.lit("secret-"), "id").alias("v"))
    for name, more in (("MASK_COLUMN", {"show_last": 0}), ("REDACT_COLUMN", {}), ("HASH_COLUMN", {}), ("PSEUDONYMIZE_COLUMN", {})):
        out = tv.run_steps(df, [Step(name, {"column": "v", **more})]).data
        assert out.filter(F.col("v").contains("secret")).isEmpty()
