"""What the plans look like: what is pushed down, read, shuffled and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

import tidyveil as tv
from tidyveil.plans.steps import Step

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition)", plan(df)))


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


@pytest.fixture(scope="module")
def customer(spark):
    return spark.read.parquet(f"{FOLDER}/customer.parquet")


def test_row_local_steps_fold_into_one_scan_without_a_shuffle(customer):
    steps = [
        Step("TRIM_WHITESPACE"),
        Step("FILTER_ROWS", {"column": "c_nationkey", "operator": ">=", "value": 3}),
        Step("MASK_COLUMN", {"column": "c_name"}),
        Step("HASH_COLUMN", {"column": "c_custkey"}),
        Step("REVENUE_BANDS", {"column": "c_acctbal"}),
        Step("NORMALIZE_DATES", {"column": "c_mktsegment"}),
        Step("REMOVE_COLUMNS", {"columns": ["c_acctbal"]}),
    ]
    df = tv.run_steps(customer, steps).data
    assert shuffles(df) == 0 and plan(df).count("FileScan") == 1 and "Python" not in plan(df)
    assert "GreaterThanOrEqual(c_nationkey,3)" in plan(df)
    assert "c_acctbal" not in re.search(r"ReadSchema: (\S+)", plan(df)).group(1)


@pytest.mark.parametrize(
    "operator, value, pushed",
    [("==", "R", "EqualTo(l_returnflag,R)"), ("!=", "R", None)],
)
def test_equality_reaches_the_scan(lineitem, operator, value, pushed):
    text = plan(tv.filter_rows(lineitem, "l_returnflag", operator, value))
    assert pushed is None or pushed in text


def test_deduplication_combines_before_its_only_shuffle(lineitem):
    df = tv.remove_duplicates(lineitem, ["l_linestatus"], "first", ["l_orderkey"])
    assert shuffles(df) == 1 and "partial_min" in plan(df) and "Window" not in plan(df)


def test_small_mappings_are_broadcast_and_rows_not_shuffled(customer):
    for df in (tv.suppress_low_counts(customer, "c_nationkey"), tv.pseudonymize_column(customer, "c_name")):
        assert "BroadcastHashJoin" in plan(df) and shuffles(df) == 0


def test_no_window_is_global_but_over_the_small_tail_of_ranges(lineitem):
    df = tv.fill_missing(lineitem, "l_tax", "forward", order_by=["l_shipdate", "l_orderkey"])
    text = plan(df)
    assert "Cartesian" not in text and "NestedLoop" not in text
    main = text.split("BroadcastExchange")[0]
    assert "Exchange SinglePartition" not in main and re.search(r"Exchange hashpartitioning\(__range", main)
    tail = re.findall(r"ReadSchema: (\S+)", text)[-1]
    assert "l_comment" not in tail and "l_partkey" not in tail and "l_extendedprice" not in tail


def test_statistics_are_one_row_subqueries(lineitem):
    for df in (
        tv.fill_missing(lineitem, "l_tax", "mean"),
        tv.fill_missing(lineitem, "l_tax", "mode"),
        tv.generalize_column(lineitem, "l_tax"),
    ):
        text = plan(df)
        assert "Subquery" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_a_salt_stands_in_no_plan(customer):
    df = tv.hash_column(customer, "c_name", salt="very-secret-salt")
    assert "very-secret-salt" not in df._jdf.queryExecution().toString() and shuffles(df) == 0
    assert "very-secret-salt" not in plan(tv.run_steps(customer, [Step("HASH_COLUMN", {"column": "c_name", "salt": "very-secret-salt"})]).data)


def test_statistics_of_many_steps_take_one_pass(spark, lineitem, monkeypatch):
    """Twenty steps that want a mean, mode, range or median: one stored aggregate, and no other scan but the main one."""
    from tidyveil.plans import statistics

    stored = []
    monkeypatch.setattr(statistics, "cut_lineage", lambda df: (stored.append(plan(df)), df.checkpoint())[1])
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    numbers = ["l_tax", "l_quantity", "l_discount", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber"]
    gaps = lineitem.select(*[F.when(F.col("l_orderkey") % 7 != i, F.col(c)).alias(c) for i, c in enumerate(numbers)], *[F.col(c).alias(f"{c}_{k}") for c in numbers for k in "ab"])
    steps = [Step("FILL_MISSING", {"column": c, "strategy": ("mean", "median", "mode")[i % 3]}) for i, c in enumerate(numbers)]
    steps += [Step("FILL_MISSING", {"column": f"{c}_a", "strategy": ("mode", "mean")[i % 2]}) for i, c in enumerate(numbers)]
    steps += [Step("GENERALIZE_COLUMN", {"column": f"{c}_b", "bins": 4}) for c in numbers]
    result = tv.run_steps(gaps, steps).data
    assert len(steps) > 20 and plan(result).count("FileScan") == 1 and len(stored) == 1 and stored[0].count("FileScan") == 1
    alone = gaps
    for step in steps:
        alone = tv.run_steps(alone, [step]).data.checkpoint()
    for c in gaps.columns:  # as by one step after the other
        a, b = (df.groupBy(F.round(c, 6) if c in numbers else F.col(c)).count() for df in (result, alone))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), c


def test_statistics_follow_what_changes_a_column(customer):
    """A statistic wanted after its column changed, or after rows went, is that of the changed table."""
    df = customer.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    steps = [
        Step("FILL_MISSING", {"column": "c_acctbal", "strategy": "median"}), Step("FILL_MISSING", {"column": "c_nationkey", "strategy": "mode"}),
        Step("GENERALIZE_COLUMN", {"column": "c_acctbal", "bins": 3}), Step("FILTER_ROWS", {"column": "c_custkey", "operator": ">", "value": 100}),
        Step("GENERALIZE_COLUMN", {"column": "c_custkey", "bins": 2}), Step("GENERALIZE_COLUMN", {"column": "c_nationkey", "bins": 2}),
    ]
    by_one = df
    for step in steps:
        by_one = tv.run_steps(by_one, [step]).data
    assert sorted(map(str, tv.run_steps(df, steps).data.collect())) == sorted(map(str, by_one.collect()))


def test_detection_and_profile_scan_once(customer):
    from tidyveil.inspection import value_pattern_rates

    for df in (value_pattern_rates(customer), tv.profile_columns(customer.select("c_name", "c_nationkey"))):
        assert plan(df).count("FileScan") == 1
    exact = plan(tv.profile_columns(customer))
    assert exact.count("FileScan") == 1 and "Expand" not in exact and "partial_count" in exact


def test_results_do_not_depend_on_partitioning(spark, lineitem):
    steps = [
        Step("REMOVE_DUPLICATES", {"subset": ["l_orderkey"]}),
        Step("FILL_MISSING", {"column": "gap", "strategy": "backward"}),
        Step("PSEUDONYMIZE_COLUMN", {"column": "l_partkey"}),
        Step("SUPPRESS_LOW_COUNTS", {"column": "l_shipdate", "threshold": 2}),
    ]
    gapped = lineitem.withColumn("gap", F.when(F.col("l_tax") == 0, F.col("l_suppkey")))
    results = []
    for width in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        df = tv.run_steps(gapped.repartition(int(width)), steps, order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).data
        results.append(sorted(map(tuple, df.collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
