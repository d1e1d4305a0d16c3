"""Delimited and JSON files in and out."""

from __future__ import annotations

import csv
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.constants import MISSING_TOKENS
from tidyveil.errors import SanitizeError
from tidyveil.functions.columns import PLAIN_NUMBER, as_text, ref
from tidyveil.plans.lineage import cut_lineage, shared_folder
from tidyveil.sources.lines import as_latin1, first_value, head_lines, numbered_lines, without_head
from tidyveil.sources.records import block_starts, chunks_of, records, with_changes
from tidyveil.sources.rows import ROW_ORDER, with_row_id

_WHOLE = r"^[+-]?\d+$"
_REAL = r"(?i)^[+-]?(inf|infinity)$"
_BEYOND = "__beyond_the_header"
#: Files with more different headers than this are not one table.
_MOST_GROUPS = 1000
_TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")


def plain_path(uri: str) -> str:
    """Spark names files by encoded URI; readers take the path itself."""
    scheme, _, rest = unquote(uri).rpartition(":")
    return f"{scheme}:{re.sub('^/+', '/', rest) if scheme == 'file' else rest}" if scheme else rest


def _column_names(cells: list[str]) -> list[str]:
    """Nameless columns become ``Unnamed: i``; a repeated name gets ``.1``, ``.2`` …"""
    names: list[str] = []
    for i, cell in enumerate(cells):
        base = name = cell if cell.strip() else f"Unnamed: {i}"
        n = 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return names


def inferred(df: DataFrame) -> DataFrame:
    """Text columns as bigint, double or boolean where every value present reads as one.

    One aggregate over the table decides; it also counts the rows with cells beyond the header, if the table was read
    with them, which are an error. A column with no value at all becomes double. Whole numbers that no bigint
    holds keep their column text: as doubles, different ones would become equal.
    """
    columns = [c for c in df.columns if c != _BEYOND]
    beyond = ref(_BEYOND) if _BEYOND in df.columns else F.lit(None).cast("string")
    kinds, figures = [beyond.alias("beyond")], [F.count("beyond").alias("beyond")]
    for i, name in enumerate(columns):
        if name in ROW_ORDER:
            continue
        c = ref(name)
        bare = F.trim(c)
        # What each cell reads as, by the first test that fits: every whole number is a number.
        kind = F.when(bare.rlike(_WHOLE), F.when(bare.try_cast("bigint").isNotNull(), 1).otherwise(2))
        kind = kind.when(bare.rlike(PLAIN_NUMBER) | bare.rlike(_REAL), 3).when(c.isin(*_TRUTH), 4).when(c.isNotNull(), 5)
        kinds.append(kind.alias(f"k{i}"))
        figures += [
            F.count(f"k{i}").alias(f"n{i}"),
            F.count_if(F.col(f"k{i}") == 1).alias(f"w{i}"),
            F.count_if(F.col(f"k{i}") == 2).alias(f"b{i}"),
            F.count_if(F.col(f"k{i}") <= 3).alias(f"r{i}"),
            F.count_if(F.col(f"k{i}") == 4).alias(f"t{i}"),
        ]
    seen = df.select(*kinds).agg(*figures).first()
    _refuse_ragged(seen["beyond"])

    def typed(i: int, name: str) -> Column:
        if name in ROW_ORDER or seen[f"b{i}"]:
            return ref(name)
        n, c = seen[f"n{i}"], F.trim(ref(name))
        if n == 0:
            return F.lit(None).cast("double").alias(name)
        if seen[f"w{i}"] == n:
            return c.try_cast("bigint").alias(name)
        if seen[f"r{i}"] == n:
            return c.try_cast("double").alias(name)
        if seen[f"t{i}"] == n:
            return c.try_cast("boolean").alias(name)
        return ref(name)

    return df.select(*[typed(i, name) for i, name in enumerate(columns)])


def _refuse_ragged(rows: int) -> None:
    if rows:
        raise SanitizeError(f"{rows} rows have more cells than the header; ragged='cut' drops what is beyond it")


def _read_text_cells(
    spark: SparkSession,
    files: str | list[str],
    delimiter: str,
    header_row: int | None,
    latin1: bool,
    names: list[str],
    multi_line: DataFrame | None,
    row_order: bool,
) -> DataFrame:
    """Cells as text under ``names``, what goes beyond them under ``_BEYOND``, and the row order if asked for.

    ``multi_line`` holds the records of the files where cells may have line breaks.
    """
    fields = [*(f"c{i}" for i in range(len(names))), "beyond"]
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if header_row or multi_line is not None:
        lines = numbered_lines(spark, files) if multi_line is None else multi_line
        body = without_head(lines, 0 if header_row is None else header_row + 1)
        value = as_latin1() if latin1 else F.col("value")
        place = [F.col(c).alias(n) for c, n in zip(("file", "block", "id"), ROW_ORDER)]
        cells = body.select(F.from_csv(value, ", ".join(f"{c} string" for c in fields), options).alias("cells"), *place)
        cells = cells.select("cells.*", *ROW_ORDER)
    else:
        reader = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in fields])).option("recursiveFileLookup", True)
        encoding = "ISO-8859-1" if latin1 else "UTF-8"
        cells = with_row_id(reader.options(**options, header=header_row == 0, encoding=encoding).csv(files))
    named = cells.toDF(*names, _BEYOND, *ROW_ORDER)
    return named if row_order else named.drop(*ROW_ORDER)


def _multi_line_records(spark: SparkSession, path: str | list[str], delimiter: str) -> DataFrame:
    """(value, file, block, id) for each record that is not blank, whatever line breaks its quoted cells hold.

    Line feeds end records; a carriage return before one goes with it. Files are split over tasks.
    """
    changes = with_changes(chunks_of(spark, path, "\n"), lambda text: _leaves_a_quote_open(delimiter, text))
    starts = block_starts(changes)
    ends = starts.groupBy("file").agg(F.max_by("ends_open", "block").alias("open")).filter("open")
    unclosed = ends.agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first")).first()
    if unclosed["n"]:
        raise SanitizeError(f"{unclosed['n']} files end within a quoted cell, as {unclosed['first']} does")
    # Trimmed rather than replaced: bytes that are no UTF-8 have to stay as they are.
    return records(changes, starts, "\n").select(F.rtrim("value", F.lit("\r")).alias("value"), "file", "block", "id")


def _leaves_a_quote_open(delimiter: str, text: Column | None = None) -> Column:
    """Lines of which the last quoted cell does not end: the cell goes on in the next line."""
    d, value = re.escape(delimiter), F.col("value") if text is None else text
    cell = rf'(?:"(?:[^"]|"")*+"[^{d}]*+|[^"{d}][^{d}]*+|)'
    return F.when(F.contains(value, F.lit('"')), ~value.rlike(rf"(?s)^{cell}(?:{d}{cell})*+$")).otherwise(False)


def _encoding_of(name: str | None) -> bool | None:
    """Whether Latin-1; None if it has to be found out."""
    if name is None:
        return None
    if name.lower().replace("_", "-") in ("latin-1", "latin1", "iso-8859-1"):
        return True
    if name.lower().replace("-", "") == "utf8":
        return False
    raise SanitizeError(f"encoding {name!r} is not supported")


def read_text_table(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str,
    header_row: int | None = 0,
    encoding: str | None = None,
    multi_line: bool = False,
    ragged: str = "refuse",
    row_order: bool = False,
    checked: bool = True,
) -> DataFrame:
    """``read_delimited`` before types: all cells as text, missing ones NULL.

    With ``checked=False`` cells beyond the header come along, for ``inferred`` to count in its own pass.
    """
    if ragged not in ("refuse", "cut"):
        raise SanitizeError(f"ragged must be 'refuse' or 'cut', not {ragged!r}")
    latin1 = _encoding_of(encoding)
    lines = numbered_lines(spark, path)
    if not lines.inputFiles():
        raise SanitizeError(f"no files at {path!r}")
    is_open = _leaves_a_quote_open(delimiter)
    if multi_line:
        lines, is_open = _multi_line_records(spark, path, delimiter), F.lit(False)
    # One scan: what every file is like. Files that are alike form a group; the driver gets the groups.
    figures = [F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.count_if(is_open).alias("open")]
    if not header_row:  # the first line comes along; a later one takes two more looks at the first block
        figures.append(first_value(F.when(F.col("block") == 0, F.col("value")), F.when(F.col("block") == 0, F.col("id"))).alias("head"))
    about = lines.groupBy("file").agg(*figures)
    wanted = header_row or 0
    is_latin1 = (~F.col("utf8") if latin1 is None else F.lit(latin1)).alias("latin1")
    if wanted:
        heads = head_lines(lines, wanted + 1).filter(F.col("row") == wanted).select(F.col("file").alias("of"), F.col("value").alias("head"))
        about = about.join(heads, F.col("file") == F.col("of"), "left")
    of_file = about.select("file", "open", is_latin1, "head")
    of_file = of_file.withColumn("head", F.when(F.col("latin1"), as_latin1("head")).otherwise(F.col("head")))
    key = F.col("head") if header_row is not None else F.lit(None).cast("string")
    facts = of_file.withColumn("key", key)
    groups = facts.groupBy("latin1", "key").agg(
        F.min(F.struct("file", "head")).alias("first"), F.sum("open").alias("open"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("head").isNull()).alias("short")
    ).limit(_MOST_GROUPS + 1).collect()
    groups.sort(key=lambda g: g["first"]["file"])
    if not groups:
        raise SanitizeError(f"no lines at {path!r}")
    if len(groups) > _MOST_GROUPS:
        raise SanitizeError(f"the files at {path!r} have more than {_MOST_GROUPS} different headers")
    if short := next((g for g in groups if g["short"]), None):
        raise SanitizeError(f"{short['first']['file']} has no line {wanted}")
    if broken := [g for g in groups if g["open"]]:
        raise SanitizeError(
            f"{sum(g['open'] for g in broken)} lines leave a quoted cell open, as in {broken[0]['first']['file']}: read with multi_line=True"
        )
    parts = []
    if len(groups) > 1:
        facts = cut_lineage(facts)
    for g in groups:
        # The path itself is read where its files are alike, rather than a long list of them.
        files: str | list[str] = path
        own = lines if multi_line else None
        if len(groups) > 1:
            same = facts.filter((F.col("latin1") == g["latin1"]) & F.col("key").eqNullSafe(F.lit(g["key"])))
            own = lines.join(same.select("file"), "file", "left_semi") if multi_line else None
        if len(groups) > 1 and not multi_line:
            files = sorted(plain_path(r["file"]) for r in same.select("file").collect())
        cells = next(csv.reader([g["first"]["head"].lstrip("\ufeff")], delimiter=delimiter))
        names = [f"_c{i}" for i in range(len(cells))] if header_row is None else _column_names(cells)
        parts.append(_read_text_cells(spark, files, delimiter, header_row, g["latin1"], names, own, row_order))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    if checked and ragged == "refuse":
        _refuse_ragged(table.filter(ref(_BEYOND).isNotNull()).count())
    names = [c for c in table.columns if c != _BEYOND or not checked and ragged == "refuse"]
    return table.select(*[ref(c) if c in ROW_ORDER or c == _BEYOND else F.when(~ref(c).isin(*MISSING_TOKENS), ref(c)).alias(c) for c in names])


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = "\t",
    header_row: int | None = 0,
    encoding: str | None = None,
    infer_types: bool = True,
    multi_line: bool = False,
    ragged: str = "refuse",
    row_order: bool = False,
) -> DataFrame:
    """A delimited file, or a folder of them, as a table.

    ``header_row`` counts lines that are not blank; lines above it are dropped in every file, and
    ``None`` means there is no header (columns ``_c0`` …). Every file has its own header: values go by
    name, and a column that a file lacks is missing in its rows. ``encoding`` is ``"utf-8"`` or
    ``"latin-1"``; if it is not given, files that are not UTF-8 are read as Latin-1. Cells that stand
    for a missing value become NULL. ``infer_types`` turns columns of numbers or truth values into
    such (one aggregate). Files are split over tasks. Cells with line breaks need ``multi_line``, which
    takes one more pass to find where records begin, and which refuses files that end within a quoted
    cell; without it a line that leaves a quoted cell open is an error. So are rows with more cells than
    their header, unless ``ragged="cut"``. ``row_order`` adds the columns ``ROW_ORDER``.
    """
    table = read_text_table(spark, path, delimiter, header_row, encoding, multi_line, ragged, row_order, not infer_types)
    return inferred(table) if infer_types else table


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    header_row: int | None = 0,
    encoding: str | None = None,
    infer_types: bool = True,
    multi_line: bool = False,
    ragged: str = "refuse",
    row_order: bool = False,
) -> DataFrame:
    """``read_delimited`` with a comma."""
    return read_delimited(spark, path, ",", header_row, encoding, infer_types, multi_line, ragged, row_order)


_NOT_JSON = "__not_json"


def _outside(text: Column) -> Column:
    """``text`` without quoted parts; one that is not closed leaves its quote and all behind it."""
    return F.regexp_replace(text, r'(?s)"(?:[^"\\]|\\.)*+"', "")


def _deeper(text: Column) -> Column:
    """By how many brackets a chunk goes deeper, with the closing brace that ends it."""
    bare = F.regexp_replace(_outside(text), '(?s)".*$', "")
    opened, closed = (F.length(F.regexp_replace(bare, kind, "")) for kind in (r"[^\[{]", r"[^\]]"))
    return (opened - closed - F.when(F.contains(_outside(text), F.lit('"')), 0).otherwise(1)).cast("bigint")


def _array_records(spark: SparkSession, files: str | list[str], row_order: bool) -> tuple[str, list[str]]:
    """A folder with the records of array files as JSON lines, and the files that are no arrays of records after all.

    A file is cut at closing braces; a record ends where one brings it back to the depth of the array.
    """
    changes = with_changes(chunks_of(spark, files, "}"), lambda text: F.contains(_outside(text), F.lit('"')), _deeper)
    starts = block_starts(changes)
    found = records(changes, starts, "}", 1)
    first = F.regexp_replace("value", "^\\x{FEFF}", "")
    body = F.regexp_replace(F.regexp_replace(first, r"^\s*[\[,]\s*\{", ""), r"[\r\n]+", " ")
    head = F.lit("{")
    if row_order:  # the place goes into the record, as its copy lies elsewhere
        place = F.to_json(F.struct(*[F.col(c).alias(n) for c, n in zip(("file", "block", "id"), ROW_ORDER)]))
        head = F.concat(F.regexp_replace(place, r"\}$", ""), F.when(F.trim(body) == "", "").otherwise(","))
    sound = F.col("whole") & first.rlike(r"^\s*[\[,]\s*\{")
    closer = ~F.col("whole") & first.rlike(r"^\s*(\[\s*)?\]\s*$")
    text = F.when(sound, F.concat(head, body, F.lit("}"))).otherwise(F.concat(F.lit("!"), F.col("file")))
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    found.filter(~closer).select(text.alias("value")).write.text(folder)
    # The last brace of an array is followed by its bracket, which has no brace behind it.
    ends = starts.groupBy("file").agg(F.max_by(F.struct("ends_open", "ends_deep"), "block").alias("end"))
    cut_off = ends.filter("end.ends_open OR end.ends_deep <> -1").select("file")
    odd = spark.read.text(folder).filter(F.startswith("value", F.lit("!"))).select(F.substring("value", 2, 1 << 30).alias("file"))
    return folder, sorted(plain_path(r["file"]) for r in cut_off.unionByName(odd).distinct().collect())


def _read_records(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """JSON lines; what cannot be read as a record is an error."""
    reader = spark.read.option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", _NOT_JSON)
    table = reader.json(files)
    if _NOT_JSON in table.columns:
        lines = spark.read.option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", _NOT_JSON).schema(f"__any string, {_NOT_JSON} string").json(files)
        seen = lines.select(_NOT_JSON, "__any", F.col("_metadata.file_path").alias("file")).filter(F.col(_NOT_JSON).isNotNull())
        bad = seen.agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first"), F.max("__any").alias("any")).first()
        raise SanitizeError(f"{bad['n']} lines hold no JSON record, the first of them in {bad['first']}")
    return table


def read_json(spark: SparkSession, path: str | list[str], row_order: bool = False) -> DataFrame:
    """JSON lines, or files that each hold one array of records; every file for itself.

    A file that begins with a bracket and is a sound array of records to its end is read as that, every other one as
    lines; a line that holds no record is an error, so an array that is cut off or followed by something is one.
    Both are split over tasks: the records of arrays are found in all parts of a file at once and copied as lines to
    ``spark.checkpoint.dir``.
    """
    chunks = chunks_of(spark, path, "}")
    begins = chunks.filter("block = 0").groupBy("file").agg(first_value(F.col("value"), F.col("id")).alias("first"))
    bracket = F.regexp_replace("first", "^\\x{FEFF}?\\s+|^\\x{FEFF}", "").startswith("[")
    kinds = cut_lineage(begins.select("file", bracket.alias("is_array")))
    counts = {r["is_array"]: r["count"] for r in kinds.groupBy("is_array").count().collect()}
    if not counts:
        return spark.read.json(path)

    def those(wanted: bool) -> str | list[str]:
        return path if len(counts) == 1 else sorted(plain_path(r["file"]) for r in kinds.filter(F.col("is_array") == wanted).select("file").collect())

    parts, lines = [], those(False) if counts.get(False) else []
    if counts.get(True):
        arrays = those(True)
        folder, no_arrays = _array_records(spark, arrays, row_order)
        if no_arrays:
            # The reader of lines takes what begins as a record and passes over what follows it in the line.
            is_whole = F.col("value").rlike(r"(?s)^\x{FEFF}?\s*(\[.*\]|\{.*\})\s*$") & F.try_parse_json("value").isNotNull()
            odd = numbered_lines(spark, no_arrays).filter(~is_whole).agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first")).first()
            if odd["n"]:
                raise SanitizeError(f"{odd['n']} lines hold no JSON record, the first of them in {odd['first']}")
            lines = no_arrays + ([lines] if isinstance(lines, str) else lines)
            arrays = sorted(set(plain_path(r["file"]) for r in kinds.filter("is_array").select("file").collect()) - set(no_arrays))
            folder = _array_records(spark, arrays, row_order)[0] if arrays else None
        if folder:
            parts.append(_read_records(spark, folder))
    if lines:
        table = _read_records(spark, lines)
        parts.append(with_row_id(table) if row_order else table)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def _flat(df: DataFrame) -> DataFrame:
    """Every cell as the text to write; nested cells as JSON text."""
    binary = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    if binary:
        raise SanitizeError(f"delimited files hold no binary: remove or encode {binary}")
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[
            (F.to_json(ref(f.name)) if isinstance(f.dataType, nested) else as_text(ref(f.name), f.dataType)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def write_delimited(df: DataFrame, path: str, delimiter: str = "\t", mode: str = "errorifexists") -> None:
    """A folder of delimited files, each with a header; missing cells are left empty."""
    (
        _flat(df)
        .write.mode(mode)
        .options(
            header=True,
            sep=delimiter,
            quote='"',
            escape='"',
            emptyValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_delimited(df, path, ",", mode)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON lines; columns without a value are kept as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
