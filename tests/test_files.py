"""Reading, writing, layouts, fingerprints, jobs."""

import datetime as dt
import hashlib
import json
import os
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tidyveil.constants import MISSING_TOKENS
from tidyveil.errors import OutputError, SanitizeError, StepError
from tidyveil.plans.fingerprint import file_fingerprints, files_fingerprint, table_fingerprint
from tidyveil.plans.job import job_history, run_job
from tidyveil.plans.steps import Step
from tidyveil.sources import (
    ROW_ORDER, detect_layout, next_free, output_name, read_csv, read_delimited, read_json, safe_output,
    with_row_id, write_csv, write_delimited, write_json,
)
from tidyveil.sources import lines as lines_module
from tidyveil.sources.lines import numbered_lines, without_head

STAFF = '''Staff ID,  First Name  ,Email,Pay,Active,Rate,Note,
7,  Ann  ,ann@example.com,"$1,000.00",True,1.5,"late, again",
8,Ben,ben@example.com,N/A,False,2,"said ""hi""",

9,null,,(45),True,nan,,
,,,,,,,
'''


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "staff.csv", STAFF))
    assert df.columns == ["Staff ID", "  First Name  ", "Email", "Pay", "Active", "Rate", "Note", "Unnamed: 7"]
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "string", "string", "boolean", "double", "string", "double"]
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == (7, "  Ann  ", "ann@example.com", "$1,000.00", True, 1.5, "late, again", None)
    assert rows[1] == (8, "Ben", "ben@example.com", None, False, 2.0, 'said "hi"', None)
    assert rows[2] == (9, None, None, "(45)", True, None, None, None)
    assert rows[3] == (None,) * 8


def test_header_places(spark, tmp_path):
    text = "Report,,\n\nMade: today,,\nID,Name,Name\n1,\"a, b\",x\n2,c,y"
    path = put(tmp_path, "banner.csv", text)
    df = read_csv(spark, path, header_row=2)
    assert df.columns == ["ID", "Name", "Name.1"]
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [(1, "a, b", "x"), (2, "c", "y")]
    assert read_csv(spark, path, header_row=None).columns == ["_c0", "_c1", "_c2"]
    assert read_csv(spark, path, header_row=None).count() == 5
    with pytest.raises(SanitizeError):
        read_csv(spark, path, header_row=40)


def test_many_files_with_odd_names_and_encodings(spark, tmp_path):
    folder = tmp_path / "all of it"
    folder.mkdir()
    put(folder, "a b.csv", "n,t\n1,é\n")
    put(folder, "c%20d.csv", "n,t\n2,ü\n".encode("latin-1"))
    put(folder, "e.csv", "n,t\n3,z\n")
    got = {r["n"]: r["t"] for r in read_csv(spark, str(folder)).collect()}
    assert got == {1: "é", 2: "ü", 3: "z"}
    head = read_csv(spark, str(folder), header_row=1)
    assert head.count() == 0
    assert {r["is_utf8"] for r in detect_layout(spark, str(folder)).collect()} == {True, False}
    with pytest.raises(SanitizeError):
        read_csv(spark, str(folder), encoding="utf-16")


def test_head_is_dropped_once_per_file_though_it_is_split(spark, tmp_path, monkeypatch):
    folder = tmp_path / "split"
    folder.mkdir()
    for k in range(3):
        put(folder, f"f{k}.csv", "banner\nn,t\n" + "".join(f"{k}{i:05d},xxxxxxxxxxxxxxxxxxxx\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = numbered_lines(spark, str(folder))
        assert lines.rdd.getNumPartitions() > 6
        assert without_head(lines, 2).count() == 12_000
        df = read_csv(spark, str(folder), header_row=1)
        assert df.count() == 12_000 and df.select("n").distinct().count() == 12_000
        monkeypatch.setattr(lines_module, "BROADCAST_BYTES", 0)  # as with a great many files
        kept = without_head(lines, 2)
        assert kept.count() == 12_000 and "block" in kept.columns and kept.select("value").distinct().count() == 12_000
        numbered = with_row_id(spark.read.text(str(folder) + "/f1.csv"))
        assert [r["value"] for r in numbered.orderBy(*ROW_ORDER).limit(3).collect()] == ["banner", "n,t", "100000,xxxxxxxxxxxxxxxxxxxx"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_delimited(spark, tmp_path):
    path = put(tmp_path, "p.txt", "id|city\n1|New York\n2|'s-Hertogenbosch\n")
    assert [r["city"] for r in read_delimited(spark, path, "|").orderBy("id").collect()] == ["New York", "'s-Hertogenbosch"]


def test_cells_with_line_breaks(spark, tmp_path):
    path = put(tmp_path, "m.csv", 'a,b\n1,"x\ny"\n')
    assert read_csv(spark, path, multi_line=True).first()["b"] == "x\ny"
    assert read_csv(spark, path, header_row=1, multi_line=True).columns == ["1", "x\ny"]


def test_json(spark, tmp_path):
    records = [{"id": 1, "t": "é"}, {"id": 2, "t": None}]
    array = put(tmp_path, "a.json", "\n \n" + json.dumps(records, indent=2))
    lines = put(tmp_path, "l.json", "\n".join(map(json.dumps, records)))
    for path in (array, lines):
        assert sorted(r["id"] for r in read_json(spark, path).collect()) == [1, 2]


@pytest.mark.parametrize(
    "text", ['[{"a":1},\n{"a":2}', '[{"a":1},\n{"a":2}\n', '[{"a":1}] x', '[{"a":1},5]', '[{"a":1} {"a":2}]', '[{"a":"x}]', '{"a":1}\nhello\n{"a":2}\n', '[{"a":1},]', '[1,\n{"id": 3}\n']
)
def test_json_that_is_cut_off_or_broken_is_refused(spark, tmp_path, text):
    with pytest.raises(SanitizeError, match="1 lines|2 lines"):
        read_json(spark, put(tmp_path, "broken.json", text))


@contextmanager
def in_small_parts(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 2])
def test_one_json_array_in_many_parts(spark, tmp_path, indent):
    rng = random.Random(indent)
    parts = ["}", "{", '"', "\\", "[", "]", ",", "\n", "é", "x" * 9, '\\"}']
    records = [{"a": i, "t": "".join(rng.choices(parts, k=rng.randrange(9))), "n": {"l": [{"k": j} for j in range(rng.randrange(3))]}} for i in range(80)]
    records.append({"a": 80, "t": "}" * 700, "n": {"l": []}})  # longer than a part
    path = put(tmp_path, "one.json", "\n " + json.dumps(records, indent=indent, ensure_ascii=False) + "\n")
    with in_small_parts(spark, 400):
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 8
        ordered = read_json(spark, path, row_order=True).orderBy(*ROW_ORDER).drop(*ROW_ORDER)
        assert [json.loads(r) for r in ordered.toJSON().collect()] == records
        assert read_json(spark, path).count() == 81


def test_empty_json_arrays(spark, tmp_path):
    folder = tmp_path / "arrays"
    folder.mkdir()
    put(folder, "a.json", " [ ]\n")
    put(folder, "b.json", '\ufeff[{}, {"a": {}},\n{"a": {"b": 1}} ]')
    got = read_json(spark, str(folder), row_order=True).orderBy(*ROW_ORDER)
    assert [None if r["a"] is None else r["a"]["b"] for r in got.collect()] == [None, None, 1]


def _quoted(rng):
    """Rows of cells with line breaks, quotes and delimiters in them."""

    def cell():
        body = "".join(rng.choices(["a", "\n", ",", '""', "é", " ", "\n\n", "x" * 20, "\r\n"], k=rng.randrange(6)))
        return rng.choice(["x", "12", '5" pipe', "a b", "", " sp "]) if rng.randrange(4) == 0 else f'"{body}"' if rng.randrange(4) else "plain"

    return [",".join(cell() for _ in range(3)) for _ in range(120)]


def test_cells_with_line_breaks_in_many_parts(spark, tmp_path, seed=0):
    """The same rows as by the reader that takes one task for a file."""
    rows = ["h1,h2,h3", *_quoted(random.Random(seed))]
    rows.append('1,"' + "long\n" * 200 + '",2')  # goes over several parts
    rows += ["", "z,z,z"]
    path = put(tmp_path, "many.csv", "\n".join(rows) + "\n" * seed)
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').schema("a string, b string, c string").csv(path)
    want = [tuple(None if x in MISSING_TOKENS else x for x in r) for r in whole.collect()]
    with in_small_parts(spark, 400):
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        got = read_csv(spark, path, multi_line=True, infer_types=False, row_order=True)
        assert [tuple(r)[:3] for r in got.orderBy(*ROW_ORDER).collect()] == want
        banner = put(tmp_path, "banner.csv", 'made,"by\nhand",\n\n' + "\n".join(rows))
        below = read_csv(spark, banner, header_row=1, multi_line=True, infer_types=False, row_order=True)
        assert below.columns[:3] == ["h1", "h2", "h3"]
        assert [tuple(r)[:3] for r in below.orderBy(*ROW_ORDER).collect()] == want


def test_cells_with_line_breaks_of_several_files(spark, tmp_path):
    folder = tmp_path / "several"
    folder.mkdir()
    put(folder, "a.csv", 'n,t\n1,"é\ny"\n')
    put(folder, "b.csv", 't,n\n"ü\r\n""z""",2\r\n'.encode("latin-1"))
    got = {r["n"]: r["t"] for r in read_csv(spark, str(folder), multi_line=True).collect()}
    assert got == {1: "é\ny", 2: 'ü\r\n"z"'}
    put(folder, "c.csv", 'n,t\n3,"never ends\n4,x\n')
    with pytest.raises(SanitizeError, match="1 files end within"):
        read_csv(spark, str(folder), multi_line=True)


def test_round_trips(spark, tmp_path):
    rows = [(1, 'a "q", b', 1e7, dt.datetime(2024, 1, 2, 3, 4, 5), True), (2, None, None, None, None), (3, " p ", 2.5e-7, dt.datetime(2024, 1, 2), False)]
    df = spark.createDataFrame(rows, "id bigint, t string, d double, at timestamp, b boolean")
    write_csv(df, str(tmp_path / "o.csv"))
    back = read_csv(spark, str(tmp_path / "o.csv"))
    assert sorted(back.select("id", "t", "d", "b").collect()) == sorted(df.select("id", "t", "d", "b").collect())
    assert "10000000.0" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "o.csv")).collect())
    write_delimited(df.select("id", F.array("id").alias("a")), str(tmp_path / "o.txt"), ";")
    assert {r["a"] for r in read_delimited(spark, str(tmp_path / "o.txt"), ";").collect()} == {"[1]", "[2]", "[3]"}
    write_json(df, str(tmp_path / "o.json"))
    assert read_json(spark, str(tmp_path / "o.json")).columns == ["at", "b", "d", "id", "t"]
    assert read_json(spark, str(tmp_path / "o.json")).count() == 3


LAYOUTS = {
    "plain.csv": ("id,name,email\n1,ann,a@x.com\n2,bob,b@x.com\n", 0, ","),
    "banner.csv": ("Company report,,\nMade: 2024-01-15,,\nID,Name,Joined on\n1,Ann,2024-01-01\n2,Bob,2023-01-01\n", 2, ","),
    "short.csv": ("Company report\n\nID,Name,Joined on\n1,Ann,2024-01-01\n2,Bob,2023-01-01\n", 1, ","),
    "pipe.txt": ("customer_id|first_name|city\nC1|Ann|New York\nC2|Bob|Rome\n", 0, "|"),
    "quoted.txt": ('id;"last; first"\n1;"a;;;b"\n2;"c,d,e"\n', 0, ";"),
    "numbers.txt": ("1\t2\n3\t4\n", 0, "\t"),
    "prose.txt": ("just words here\nand here\n", 0, None),
}


def test_layouts(spark, tmp_path):
    for name, (text, _, _) in LAYOUTS.items():
        put(tmp_path, name, text)
    found = {os.path.basename(r["file"]): (r["header_row"], r["delimiter"]) for r in detect_layout(spark, str(tmp_path)).collect()}
    assert found == {name: (row, sign) for name, (_, row, sign) in LAYOUTS.items()}


def test_output_names(spark, tmp_path):
    source = put(tmp_path, "s.csv", "a\n1\n")
    assert output_name("/x/s.csv") == "s_sanitized.csv"
    taken = put(tmp_path, "t.csv", "x")
    assert next_free(spark, taken) == str(tmp_path / "t (2).csv")
    assert safe_output(spark, source, str(tmp_path / "out") + "/") == str(tmp_path / "out" / "s_sanitized.csv")
    for bad in (source, str(tmp_path / "S.csv"), str(tmp_path)):
        with pytest.raises(OutputError):
            safe_output(spark, source, bad)
    with pytest.raises(OutputError):
        safe_output(spark, source, taken, "error")
    assert safe_output(spark, source, taken, "replace") == taken


def test_table_fingerprints(spark):
    df = spark.range(1000).select("id", (F.col("id") / 3).alias("d"), F.array("id").alias("a"))
    for strong in (False, True):
        first = table_fingerprint(df, strong).first()
        assert table_fingerprint(df.repartition(7), strong).first() == first and first["rows"] == 1000
        changed = df.withColumn("d", F.when(F.col("id") == 500, 0.0).otherwise(F.col("d")))
        assert table_fingerprint(changed, strong).first() != first
        assert table_fingerprint(df.union(df), strong).first() != table_fingerprint(df.filter("false"), strong).first()
        assert table_fingerprint(df.filter("false"), strong).first()["rows"] == 0


def _sealed(data: bytes) -> str:
    """The digest by its definition, without Spark."""
    lines = data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]
    hashes = [hashlib.sha256(b"%d:%s" % (i, line)).hexdigest() for i, line in enumerate(lines)]
    sums = [sum(int(h[15 * k : 15 * k + 15], 16) for h in hashes) for k in range(4)]
    return hashlib.sha256(":".join(map(str, [len(lines), *sums])).encode()).hexdigest()


def test_file_fingerprints(spark, tmp_path):
    digests = set()
    for k, data in enumerate([b"a\n1\n", b"a\n1", b"1\na\n", b"a\r\n1\n", b"", b"\xff\x00\n\xfe"]):
        rows = file_fingerprints(spark, put(tmp_path, f"x{k}.csv", data)).collect()
        assert [(r["bytes"], r["digest"]) for r in rows] == [(len(data), _sealed(data))] * bool(data)
        digests.add(files_fingerprint(spark, str(tmp_path / f"x{k}.csv")))
    assert len(digests) == 6
    path = put(tmp_path, "long.csv", "".join(f"{i} {'x' * (i % 50)}\n" for i in range(5000)))
    whole = files_fingerprint(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert files_fingerprint(spark, path) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_every_file_has_its_own_header(spark, tmp_path):
    folder = tmp_path / "own"
    folder.mkdir()
    put(folder, "a.csv", "a,b\n1,x\n")
    put(folder, "b.csv", "b,a\ny,2\n")
    put(folder, "c.csv", "a,c,b\n3,true,z\n")
    got = {tuple(r) for r in read_csv(spark, str(folder)).select("a", "b", "c").collect()}
    assert got == {(1, "x", None), (2, "y", None), (3, "z", True)}
    by_file = read_csv(spark, str(folder), row_order=True).orderBy(*ROW_ORDER)
    assert [r["a"] for r in by_file.collect()] == [1, 2, 3]


def test_nothing_is_lost_in_silence(spark, tmp_path):
    ragged = put(tmp_path, "r.csv", "a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(SanitizeError, match="1 rows"):
        read_csv(spark, ragged)
    assert sorted(map(tuple, read_csv(spark, ragged, ragged="cut").collect()))[:2] == [(1, 2), (3, 4)]
    with pytest.raises(SanitizeError, match="multi_line"):
        read_csv(spark, put(tmp_path, "q.csv", 'a,b\n1,"x\ny"\n'))
    assert read_csv(spark, put(tmp_path, "i.csv", 'a,b\n1,5" pipe\n')).first()["b"] == '5" pipe'
    long = put(tmp_path, "l.csv", "id,n\n123456789012345678901,1\n123456789012345678902,2\n")
    assert [r["id"] for r in read_csv(spark, long).orderBy("n").collect()] == ["123456789012345678901", "123456789012345678902"]
    with pytest.raises(SanitizeError, match="binary"):
        write_csv(spark.sql("SELECT 1 AS a, X'00' AS b"), str(tmp_path / "never.csv"))


def test_json_is_decided_by_file(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    put(folder, "a.json", '[{"a":1},{"a":2}]')
    put(folder, "b.json", '{"a":3}\n{"a":4}\n{"a":5}')
    put(folder, "c.json", '[{"a":6}]\n[{"a":7},{"a":8}]\n')
    assert sorted(r["a"] for r in read_json(spark, str(folder)).collect()) == list(range(1, 9))


def test_layouts_are_found_by_file(spark, tmp_path):
    from tidyveil.plans.job import read_table

    folder = tmp_path / "layouts.csv"
    folder.mkdir()
    put(folder, "a.csv", "Name,City\nAnn,Ulm\nBob,Bonn\n")
    put(folder, "b.csv", "Report;;\nby hand;;\nCity;Name;Note\nKiel;Cyd;x\n")
    got = {tuple(r) for r in read_table(spark, str(folder), layout="auto").select("Name", "City").collect()}
    assert got == {("Ann", "Ulm"), ("Bob", "Bonn"), ("Cyd", "Kiel")}


def test_jobs_follow_the_order_of_the_file(spark, tmp_path):
    source = put(tmp_path, "o.csv", "k,v\n1,9\n1,2\n2,\n,5\n,5\n")
    keep = [Step("REORDER_COLUMNS", {"order": ["v", "k"]}), Step("REMOVE_EMPTY_ROWS"), Step("REMOVE_DUPLICATES", {"subset": ["k"]})]
    record = run_job(spark, source, str(tmp_path / "k.parquet"), steps=keep).first()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "k.parquet")).collect())) == ["Row(v=5, k=None)", "Row(v=9, k=1)", "Row(v=None, k=2)"]
    assert [(s["cols_before"], s["cols_after"]) for s in record["steps"]] == [(2, 2)] * 3
    run_job(spark, source, str(tmp_path / "f.parquet"), steps=[Step("FILL_MISSING", {"column": "v", "strategy": "forward"}), Step("REMOVE_DUPLICATES")])
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "f.parquet")).collect())) == sorted(["Row(k=1, v=9)", "Row(k=1, v=2)", "Row(k=2, v=2)", "Row(k=None, v=5)"])


def test_a_job_never_leaves_out_protection(spark, tmp_path):
    source, target = put(tmp_path, "s.csv", "k,secret\n1,abc\n"), str(tmp_path / "t.csv")
    with pytest.raises(StepError):
        run_job(spark, source, target, steps=[Step("HASH_COLUMN", {"column": "secret", "algorithm": "crc"})], on_error="skip")
    assert not os.path.exists(target)
    other = run_job(spark, source, target, steps=[Step("RENAME_COLUMNS", {"mapping": {"k": "secret"}})], on_error="skip").first()
    assert other["status"] == "incomplete"


def test_job(spark, tmp_path):
    source, audit = put(tmp_path, "in.csv", STAFF), str(tmp_path / "audit")
    steps = [Step("TRIM_WHITESPACE"), Step("REMOVE_EMPTY_ROWS"), Step("HASH_COLUMN", {"column": "Email"})]
    for expected in ("in_sanitized.csv", "in_sanitized (2).csv"):
        record = run_job(spark, source, str(tmp_path / "out") + "/", ["Staff ID", "Email", "gone"], steps, audit_path=audit).first()
        assert os.path.basename(record["output_path"]) == expected
        assert (record["status"], record["row_count"], record["column_count"]) == ("success", 3, 2)
        assert [(s["rows_before"], s["rows_after"]) for s in record["steps"]] == [(4, 4), (4, 3), (3, 3)]
        assert record["source_hash"] == files_fingerprint(spark, source) and len(record["output_hash"]) == 64
    with pytest.raises(StepError):
        run_job(spark, source, str(tmp_path / "never.csv"), steps=[Step("MASK_COLUMN", {"column": "gone"})], audit_path=audit)
    with pytest.raises(OutputError):
        run_job(spark, source, source, audit_path=audit)
    with pytest.raises(SanitizeError):
        run_job(spark, str(tmp_path / "none.csv"), str(tmp_path / "x.csv"), audit_path=audit)
    history = job_history(spark, audit).collect()
    assert [r["status"] for r in history] == ["error"] * 3 + ["success"] * 2
    assert "nothing would be protected" in history[2]["error_message"]
    assert not os.path.exists(tmp_path / "never.csv")


def test_job_finds_the_layout_and_changes_format(spark, tmp_path):
    source = put(tmp_path, "in.csv", "Company report,,\nMade by hand,,\nID,Full name,Pay\n1,Ann,$5\n2,Bob,$6\n")
    run_job(spark, source, str(tmp_path / "o.parquet"), steps=[Step("NORMALIZE_NUMBERS", {"column": "Pay"})], read_options={"layout": "auto"})
    assert sorted(r["Pay"] for r in spark.read.parquet(str(tmp_path / "o.parquet")).collect()) == [5.0, 6.0]
    none = Step("FILTER_ROWS", {"column": "Pay", "operator": "==", "value": "$7"})
    empty = run_job(spark, source, str(tmp_path / "none.json"), steps=[none], read_options={"header_row": 2}).first()
    assert (empty["status"], empty["row_count"]) == ("success", 0)
    texts = spark.createDataFrame([(1, "one\ntwo"), (2, "a\n\nb"), (3, 'say "x"\n')], "id int, text string")
    texts.write.parquet(str(tmp_path / "texts.parquet"))
    assert run_job(spark, str(tmp_path / "texts.parquet"), str(tmp_path / "texts.csv")).first()["row_count"] == 3
    copy = run_job(spark, source, str(tmp_path / "copy.json"), fingerprints=False).first()
    assert copy["row_count"] == 4 and copy["source_hash"] == ""


def test_one_file_in_order_without_one_large_sort(spark, tmp_path, monkeypatch):
    """Many tasks sort what one file holds; ties and missing keys included."""
    from checks import files

    monkeypatch.setattr(files, "_SORTED_ROWS", 50)
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 10 > 0, F.col("id") % 5).alias("v"))
    sorts = []
    monkeypatch.setattr(files, "cut_lineage", lambda df: sorts.append(df.rdd.glom().map(len).collect()) or df.checkpoint())
    one = files._in_one_file(rows, F.desc("v"), "k")
    one.select("k", "v").write.csv(str(tmp_path / "one"))
    assert len(sorts[0]) == 22 and max(sorts[0]) < 500
    parts = [p for p in os.listdir(tmp_path / "one") if p.startswith("part-")]
    got = [tuple(int(x) if x else None for x in line.split(",")) for line in open(tmp_path / "one" / parts[0]).read().splitlines()]
    want = sorted(((r["k"], r["v"]) for r in rows.collect()), key=lambda r: (-r[1] if r[1] is not None else 9, r[0]))
    assert len(parts) == 1 and got == want


def test_first_line_of_files_without_a_sort(spark):
    lines = spark.createDataFrame([("f", 0, 9, "late"), ("f", 0, 2, "first"), ("f", 5, 1, "far"), ("g", 0, 3, None), ("g", 0, 4, "x"), ("h", 7, 1, "y")], "file string, block long, id long, value string")
    begun = F.col("block") == 0
    first = lines.groupBy("file").agg(lines_module.first_value(F.when(begun, F.col("value")), F.when(begun, F.col("id"))).alias("head"), F.count_if(begun).alias("n"))
    assert {r["file"]: (r["head"], r["n"]) for r in first.collect()} == {"f": ("first", 2), "g": (None, 2), "h": (None, 0)}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan


def test_array_file_is_sorted_by_many_tasks(spark, tmp_path, monkeypatch):
    from checks import files
    from checks.registry import QUERIES

    keys = spark.range(300).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("5-LOW").alias("o_orderpriority"))
    keys.write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(files, "_SORTED_ROWS", 50)
    sorts = []
    monkeypatch.setattr(files, "cut_lineage", lambda df: sorts.append(df.rdd.glom().map(len).collect()) or df.checkpoint())
    got = {(r["o_orderkey"], r["o_custkey"], r["priority"]) for r in QUERIES["json_array_in_parts"](spark, str(tmp_path)).collect()}
    assert got == {(i, i % 7, "}5-LOW{[") for i in range(300)}
    assert [len(s) for s in sorts] == [8] and max(sorts[0]) < 200
