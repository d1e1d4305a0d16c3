"""Operators on small tables, against plain Python or pandas where there is something to work out."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tidyveil as tv
from tidyveil.errors import StepError
from tidyveil.operators.lookup import attach_by_value
from tidyveil.operators.ordering import row_numbers_between
from tidyveil.operators.privacy import pseudonyms

NAN = float("nan")


@pytest.fixture(scope="module")
def staff(spark):
    rows = [
        (1, "  Ada ", "ada@example.com", "$75,000.00", "01/15/1990", "Yes", None, "Eng"),
        (2, " Bo", "bo@example.com", "€62,500", "1985-03-22", "true", None, "Mkt"),
        (3, "Cy ", None, "85000", "22-07-1992", "1", None, "Eng"),
        (4, None, "di@example.com", "(45,000)", "Mar 5, 1988", "No", None, "HR"),
        (5, "", "ed@example.com", "  $110,000  ", "1995.11.30", "0", None, "Eng"),
    ]
    names = "id int, `  Name  ` string, Email string, Salary string, DoB string, Active string, Empty string, Dept string"
    return spark.createDataFrame(rows, names)


def column(df, name, order="id"):
    return [r[0] for r in df.orderBy(order).select(F.col(f"`{name}`")).collect()]


def test_trim(staff):
    trimmed = tv.trim_whitespace(staff)
    assert trimmed.columns[1] == "Name"
    assert column(trimmed, "Name") == ["Ada", "Bo", "Cy", None, ""]


def test_trim_refuses_colliding_headers(spark):
    with pytest.raises(StepError):
        tv.trim_whitespace(spark.createDataFrame([(1, 2)], "`a ` int, `a` int"))


def test_empty_rows_and_columns(spark, staff):
    assert "Empty" not in tv.remove_empty_columns(staff).columns
    df = spark.createDataFrame([(" ", NAN), (None, None), ("x", NAN), ("\xa0", 1.0)], "a string, b double")
    assert tv.remove_empty_rows(df).count() == 2
    nothing = df.filter("false")
    assert tv.remove_empty_rows(nothing).columns == ["a", "b"]
    assert tv.remove_empty_columns(nothing).columns == []


def test_absent_columns_change_nothing(staff):
    for result in (
        tv.mask_column(staff, "none"), tv.redact_column(staff, "none"), tv.hash_column(staff, "none"),
        tv.pseudonymize_column(staff, "none"), tv.generalize_column(staff, "none"), tv.revenue_bands(staff, "none"),
        tv.suppress_low_counts(staff, "none"), tv.fill_missing(staff, "none"), tv.normalize_dates(staff, "none"),
        tv.normalize_numbers(staff, "none"), tv.normalize_booleans(staff, "none"), tv.filter_rows(staff, "none", "==", 1),
        tv.replace_values(staff, "none", "a", "b"), tv.remove_columns(staff, ["none"]), tv.select_columns(staff, ["none"]),
        tv.filter_rows(staff, "Dept", "like", "x"), tv.fill_missing(staff, "Dept", "guess"), tv.mask_column(staff, "email"),
    ):
        assert result.schema == staff.schema
        assert sorted(result.collect(), key=str) == sorted(staff.collect(), key=str)


def test_awkward_names(spark):
    df = spark.createDataFrame([("secret", 1)], "`a.b` string, `c``d e` int")
    assert tv.mask_column(df, "a.b", show_last=0).first()["a.b"] == "******"
    assert tv.fill_missing(df, "c`d e", "mean").first()["c`d e"] == 1.0
    assert tv.rename_columns(df, {"a.b": "x"}).columns == ["x", "c`d e"]
    assert tv.suppress_low_counts(df, "a.b").first()[0] == "[SUPPRESSED]"
    assert tv.pseudonymize_column(df, "c`d e").first()[1] == "ENTITY_0001"
    assert tv.fill_missing(df, "a.b", "forward", order_by=["c`d e"]).first()[0] == "secret"
    assert tv.remove_duplicates(df, ["a.b"], order_by=["c`d e"]).columns == ["a.b", "c`d e"]


def test_nested_cells_are_refused(spark):
    df = spark.range(1).select(F.array("id").alias("a"))
    for call in (lambda: tv.mask_column(df, "a"), lambda: tv.hash_column(df, "a"), lambda: tv.fill_missing(df, "a")):
        with pytest.raises(StepError):
            call()


def test_renaming(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tv.rename_columns(df, {"a": "b", "b": "a", "z": "y"}).first().asDict() == {"b": 1, "a": 2}
    with pytest.raises(StepError):
        tv.rename_columns(df, {"a": "b"})


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_duplicates_against_pandas(spark, keep):
    import pandas as pd

    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot"] * 9 + [None, "x", "y"]), rnd.choice([1.0, 2.0, None]), rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a string, b double, c double").repartition(7)
    expected = pd.DataFrame(rows, columns=list("iabc")).drop_duplicates(["a", "b"], keep=keep)
    got = tv.remove_duplicates(df, ["a", "b"], keep, ["i"])
    assert got.columns == ["i", "a", "b", "c"]
    assert sorted(r["i"] for r in got.collect()) == sorted(expected.i)


def test_duplicates_with_nan_nested_and_no_order(spark):
    df = spark.createDataFrame([(NAN, 1), (None, 2), (1.0, 3)], "a double, b int")
    assert [r["b"] for r in tv.remove_duplicates(df, ["a"]).orderBy("b").collect()] == [1, 3]
    mapped = df.select("b", F.lit(1).alias("k"), F.create_map(F.lit("x"), "b").alias("m"))
    assert tv.remove_duplicates(mapped, ["k"], "last", ["b"]).first()["m"] == {"x": 3}
    assert tv.remove_duplicates(spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "a int, b int"), keep=False).count() == 1


def test_filters(spark):
    df = spark.createDataFrame([(1, "5", 5.0), (2, "x", NAN), (3, None, None), (4, "10", 10.0)], "id int, t string, d double")
    ids = lambda r: [x["id"] for x in r.orderBy("id").collect()]
    assert ids(tv.filter_rows(df, "t", "==", "5")) == [1]
    assert ids(tv.filter_rows(df, "d", "==", "5")) == [1]
    assert ids(tv.filter_rows(df, "d", "==", "five")) == []
    assert ids(tv.filter_rows(df, "d", "!=", 5)) == [2, 3, 4]
    assert ids(tv.filter_rows(df, "t", "!=", "x")) == [1, 3, 4]
    assert ids(tv.filter_rows(df, "t", ">", 5)) == [4]
    assert ids(tv.filter_rows(df, "d", ">=", "5")) == [1, 4]
    assert ids(tv.filter_rows(df, "id", "<", 2.5)) == [1, 2]
    assert ids(tv.filter_rows(df, "t", "contains", "X|1")) == [2, 4]
    assert ids(tv.filter_rows(df, "t", "not_contains", "x|1")) == [1, 3]
    assert ids(tv.filter_rows(df, "t", "contains", "|", literal=True)) == []
    assert ids(tv.search_rows(df, "10")) == [4]
    assert ids(tv.search_rows(df, "  ")) == [1, 2, 3, 4]
    with pytest.raises(StepError):
        tv.filter_rows(df, "d", ">", "many")
    with pytest.raises(StepError):
        tv.filter_rows(df, "t", "contains", "(")


def test_fill_types(spark):
    df = spark.createDataFrame([(1, 4, None, None), (2, None, "a", True), (3, 4, "7", None), (4, 1, None, None)], "id int, n int, t string, b boolean")
    assert column(tv.fill_missing(df, "n", value=9), "n") == [4, 9, 4, 1]
    assert column(tv.fill_missing(df, "n", value="none"), "n") == ["4", "none", "4", "1"]
    assert column(tv.fill_missing(df, "n"), "n") == ["4", "", "4", "1"]
    assert column(tv.fill_missing(df, "n", value=2.5), "n") == [4.0, 2.5, 4.0, 1.0]
    assert column(tv.fill_missing(df, "n", "mean"), "n") == [4.0, 3.0, 4.0, 1.0]
    assert column(tv.fill_missing(df, "n", "median"), "n") == [4.0, 4.0, 4.0, 1.0]
    assert column(tv.fill_missing(df, "n", "median", approx=True), "n")[1] == 4.0
    assert column(tv.fill_missing(df, "t", "mean"), "t") == ["7.0", "a", "7", "7.0"]
    assert column(tv.fill_missing(df, "t", "mode"), "t") == ["7", "a", "7", "7"]
    assert column(tv.fill_missing(df, "b", value=False), "b") == [False, True, False, False]
    empty = df.select("id", F.lit(None).cast("string").alias("t"))
    assert column(tv.fill_missing(empty, "t", "mode"), "t") == [""] * 4
    assert tv.fill_missing(df, "n", "drop").count() == 3
    with pytest.raises(StepError):
        tv.fill_missing(df, "n", "forward")


def _plain_fill(rows, backward, grouped):
    out, last = {}, {}
    for i, g, v in sorted(rows, reverse=backward):
        key = g if grouped else 0
        if v is not None:
            last[key] = v
        out[i] = last.get(key)
    return out


@pytest.mark.parametrize("width, grouped, backward", [("3", True, False), ("40", True, True), ("40", False, False), ("3", False, True)])
def test_carry_fill_against_plain_loop(spark, width, grouped, backward):
    """A third of the rows in one group, long gaps, groups with no value, a missing group."""
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        g = "hot" if rnd.random() < 0.35 else rnd.choice(["a", "b", "c", None, *map(str, range(200))])
        v = None if rnd.random() < 0.9 or g == "b" or 500 < i < 1500 else rnd.randrange(1000)
        rows.append((i, g, v))
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        df = spark.createDataFrame(rows, "i int, g string, v int").repartition(11)
        filled = tv.fill_missing(
            df, "v", "backward" if backward else "forward", order_by=["i"], partition_by=["g"] if grouped else None
        )
        assert filled.columns == ["i", "g", "v"]
        got = {r["i"]: r["v"] for r in filled.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == _plain_fill(rows, backward, grouped)


@pytest.mark.parametrize(
    "kind, make",
    [
        ("timestamp", lambda i: F.timestamp_micros(F.lit(1_700_000_000_000_000) + i * 1_000_003)),
        ("timestamp_ntz", lambda i: F.timestamp_micros(F.lit(1_700_000_000_000_000) + i * 1_000_003).cast("timestamp_ntz")),
        ("date", lambda i: F.date_add(F.lit("1969-01-01").cast("date"), i.cast("int"))),
        ("double", lambda i: i / 7 - 30),
        ("decimal", lambda i: (i * F.lit(1.25)).cast("decimal(20,4)")),
        ("string", lambda i: F.concat(F.lit("it's \\ \"q\" é"), F.lpad(i.cast("string"), 6, "0"))),
    ],
)
def test_carry_fill_orders_by_any_type(spark, kind, make):
    df = spark.range(1000).select(
        "id", make(F.col("id")).alias("k"), F.when(F.pmod(F.xxhash64("id"), F.lit(9)) == 0, F.col("id")).alias("v")
    )
    filled = tv.fill_missing(df.repartition(5), "v", "forward", order_by=["k"])
    expected = _plain_fill([(r["id"], 0, r["v"]) for r in df.collect()], False, False)
    assert {r["id"]: r["v"] for r in filled.collect()} == expected


def test_carry_fill_with_missing_and_tied_order(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, "b"), (2, None), (3, None)], "k int, v string")
    got = tv.fill_missing(df, "v", "forward", order_by=["k"]).orderBy("k").collect()
    assert [r["v"] for r in got if r["k"] == 1] == ["a", "a"]
    assert [r["v"] for r in got if r["k"] == 3] == ["b"]


@pytest.mark.parametrize("size", [0, 1, 2, 1001, 1002])
def test_median_against_statistics(spark, size):
    rnd = random.Random(size)
    values = [rnd.choice([7.0, rnd.gauss(0, 1e6), float(rnd.randrange(50))]) for _ in range(size)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None, NAN])], "id int, v double").repartition(5)
    filled = tv.fill_missing(df, "v", "median").filter(F.col("id") == size).first()["v"]
    assert filled == (statistics.median(values) if values else None)


def test_replacing(spark):
    df = spark.createDataFrame([(1, "a.b$c", 1.5), (2, None, None)], "id int, t string, d double")
    assert column(tv.replace_values(df, "t", ".", "-"), "t") == ["a-b$c", None]
    assert column(tv.replace_values(df, "t", "$", r"\1"), "t") == ["a.b\\1c", None]
    assert column(tv.replace_values(df, "t", r"(\w)\.(\w)", r"\2$\1", regex=True), "t") == ["b$a$c", None]
    assert column(tv.replace_values(df, "d", "1.", "2."), "d") == ["2.5", None]
    assert column(tv.replace_values(df, "t", "", "_"), "t") == ["_".join(["", *"a.b$c", ""]), None]


def test_masks(spark):
    df = spark.createDataFrame([(1, "alice@example.com"), (2, "abc"), (3, None), (4, "né😀xyz")], "id int, t string")
    assert column(tv.mask_column(df, "t"), "t") == ["*************.com", "***", None, "**😀xyz"]
    hidden = column(tv.mask_column(df, "t", show_last=0), "t")
    assert hidden == ["*" * 17, "***", None, "*" * 6]
    assert column(tv.mask_column(spark.createDataFrame([(1, 123456)], "id int, t int"), "t", "#"), "t") == ["##3456"]


def test_hashes(spark):
    import hashlib

    df = spark.createDataFrame([(1, "é"), (2, None)], "id int, t string")
    for name in ("sha256", "sha224", "sha384", "sha512", "md5", "sha1"):
        assert column(tv.hash_column(df, "t", name, "s"), "t") == [hashlib.new(name, "sé".encode()).hexdigest(), None]
    with pytest.raises(StepError):
        tv.hash_column(df, "t", "crc32")


def test_pseudonyms_are_one_to_one(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 11 != 0, F.col("id") % 12_000).alias("t"))
    labelled = tv.pseudonymize_column(df, "t", prefix="P", seed=3)
    both = labelled.join(df.withColumnRenamed("t", "old"), "id")
    pairs = both.select("old", "t").distinct()
    assert pairs.count() == pairs.select("t").distinct().count() == pairs.select("old").distinct().count()
    assert labelled.filter("t is null").count() == df.filter("t is null").count()
    numbers = sorted(int(r["t"][2:]) for r in pairs.filter("t is not null").collect())
    assert numbers == list(range(1, len(numbers) + 1))
    again = tv.pseudonymize_column(df.repartition(3), "t", prefix="P", seed=3)
    assert again.exceptAll(labelled).isEmpty()
    other = tv.pseudonymize_column(df, "t", prefix="P", seed=4)
    assert not other.exceptAll(labelled).isEmpty()


def test_lookup_is_the_same_with_and_without_broadcast(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 900).cast("string")).alias("k")
    )
    values = df.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("copies")).withColumnRenamed("k", "key")
    mapping = pseudonyms(values, "P", 1)
    small, large = attach_by_value(df, "k", mapping), attach_by_value(df, "k", mapping, broadcast_rows=10)
    assert large.columns == small.columns
    assert large.exceptAll(small).isEmpty()
    assert large.count() == 5000


def test_suppression(spark):
    rows = [(i, d) for i, d in enumerate(["Eng"] * 10 + ["Ops"] * 2 + ["HR"] * 5 + [None] * 2)]
    df = spark.createDataFrame(rows, "id int, d string")
    got = column(tv.suppress_low_counts(df, "d"), "d")
    assert got == ["Eng"] * 10 + ["[SUPPRESSED]"] * 2 + ["HR"] * 5 + [None] * 2


def test_suppression_with_many_values(spark, monkeypatch):
    import tidyveil.operators.grouping as grouping

    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("v"), F.floor(F.col("id") / 6))).alias("d"))
    plain = tv.suppress_low_counts(df, "d", 3)
    shuffled = tv.suppress_low_counts(df, "d", 3, broadcast_rows=5)
    assert shuffled.exceptAll(plain).isEmpty() and shuffled.count() == 4000


def test_ranges(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 20, 20.1, 50, 100])] + [(9, None), (10, NAN)], "id int, v double")
    texts = column(tv.generalize_column(df, "v"), "v")
    assert texts == ["[0.0, 20.0]", "[0.0, 20.0]", "(20.0, 40.0]", "(40.0, 60.0]", "(80.0, 100.0]", None, None]
    assert column(tv.generalize_column(df, "v", bins=[0, 20, 60]), "v") == ["[0, 20]", "[0, 20]", "(20, 60]", "(20, 60]", None, None, None]
    assert column(tv.generalize_column(df, "v", bins=2, labels=["lo", "hi"]), "v")[:5] == ["lo", "lo", "lo", "lo", "hi"]
    same = spark.createDataFrame([(1, 5), (2, 5)], "id int, v int")
    assert column(tv.generalize_column(same, "v", bins=2), "v") == ["[4.995, 5.0]"] * 2
    assert column(tv.generalize_column(spark.createDataFrame([(1, 34), (2, 38), (3, -35)], "id int, v int"), "v", round_to=10), "v") == [30, 40, -40]
    dates = spark.createDataFrame([(1, "2026-03-25"), (2, "March 5, 2025"), (3, "x")], "id int, v string")
    assert column(tv.generalize_column(dates, "v", date_unit="month"), "v") == ["2026-03", "2025-03", None]
    assert column(tv.generalize_column(dates, "v", date_unit="year"), "v") == ["2026", "2025", None]
    for bad in ({"bins": 0}, {"bins": [3, 1]}, {"bins": 2, "labels": ["a"]}, {"round_to": 0}, {"date_unit": "day"}):
        with pytest.raises(StepError):
            tv.generalize_column(df, "v", **bad)


def test_bands(spark):
    edges = [-1, 9999, 10000, 10001, 50000, 100000, 500000, 1000000, 1000001]
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(edges)] + [(99, "n/a")], "id int, v string")
    assert column(tv.revenue_bands(df, "v"), "v") == [
        "<10K", "<10K", "<10K", "10K–50K", "10K–50K", "50K–100K", "100K–500K", "500K–1M", "1M+", None,
    ]


def test_pages(spark):
    df = spark.range(30_000).select((F.col("id") % 5).alias("k"), "id").repartition(6)
    wanted = [(r["k"], r["id"]) for r in df.orderBy("k", "id").collect()]
    rows, pages = tv.page(df, 2, 25, ["k", "id"])
    assert pages == 1200 and [tuple(r) for r in rows.collect()] == wanted[50:75]
    rows, _ = tv.page(df, 50, 500, ["k", "id"])
    assert [tuple(r) for r in rows.collect()] == wanted[25_000:25_500]
    rows, _ = tv.page(df, 1200, 25, ["k", "id"])
    assert [tuple(r) for r in rows.collect()] == wanted[:25]
    tied = row_numbers_between(df, ["k"], 1, 30_000)
    assert tied.select("id").distinct().count() == 30_000
    assert tv.page_count(0, 25) == 1
    with pytest.raises(StepError):
        tv.page(df, 0, 30, ["k"])


def test_no_nan_comes_out(spark):
    df = spark.createDataFrame([(1, NAN), (2, 2.0)], "id int, v double")
    for result in (
        tv.fill_missing(df, "v", "mean"), tv.fill_missing(df, "v", "median"), tv.fill_missing(df, "v", "mode"),
        tv.fill_missing(df, "v", value=0), tv.normalize_numbers(df, "v"), tv.remove_duplicates(df),
    ):
        assert result.filter(F.isnan("v")).isEmpty()
    assert isinstance(tv.normalize_numbers(df, "v").schema["v"].dataType, T.DoubleType)
