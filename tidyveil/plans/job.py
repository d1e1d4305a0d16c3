"""A whole job: read, select, run the steps, write, check, and keep a record."""

from __future__ import annotations

import posixpath
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyveil.constants import ROW_ORDER
from tidyveil.errors import SanitizeError
from tidyveil.operators.projection import select_columns
from tidyveil.plans.fingerprint import files_fingerprint
from tidyveil.plans.lineage import cut_lineage
from tidyveil.plans.runner import run_steps
from tidyveil.plans.steps import Step, load_steps, needs_order
from tidyveil.sources import files
from tidyveil.sources.layout import detect_layout
from tidyveil.sources.paths import check_written, exists, safe_output
from tidyveil.sources.rows import with_row_id

AUDIT_SCHEMA = (
    "job_id string, source_path string, output_path string, source_hash string, output_hash string, "
    "status string, started_at timestamp, finished_at timestamp, duration_seconds double, "
    "row_count bigint, column_count int, columns_selected array<string>, error_message string, "
    "summary string, steps array<struct<step:int,step_name:string,rows_before:bigint,rows_after:bigint,"
    "cols_before:int,cols_after:int,success:boolean,error:string>>"
)
_FORMATS = {".csv": "csv", ".txt": "txt", ".tsv": "txt", ".json": "json", ".parquet": "parquet"}


def format_of(path: str) -> str:
    suffix = posixpath.splitext(path.rstrip("/"))[1].lower()
    if suffix not in _FORMATS:
        raise SanitizeError(f"cannot tell the format of {path!r}; name it .csv, .txt, .json or .parquet")
    return _FORMATS[suffix]


def read_table(spark: SparkSession, path: str, kind: str | None = None, row_order: bool = False, **options: Any) -> DataFrame:
    """Read by suffix. ``layout="auto"`` finds header row and delimiter of each delimited file first.

    Files of different layout are read each in its own and put together by column name. ``row_order`` adds the columns
    ``ROW_ORDER``.
    """
    kind = kind or format_of(path)
    layout = options.pop("layout", None)
    if kind == "parquet":
        table = spark.read.parquet(path)
        return with_row_id(table) if row_order else table
    if kind == "json":
        return files.read_json(spark, path, row_order)
    options.setdefault("delimiter", "," if kind == "csv" else "\t")
    if layout != "auto":
        return files.read_delimited(spark, path, row_order=row_order, **options)
    found = cut_lineage(detect_layout(spark, path).withColumn("delimiter", F.coalesce("delimiter", F.lit(options["delimiter"]))))
    layouts = found.groupBy("header_row", "delimiter").agg(F.min("file").alias("first")).orderBy("first").collect()
    infer = options.pop("infer_types", True)
    parts = []
    for each in layouts:
        own: str | list[str] = path
        if len(layouts) > 1:
            same = found.filter((F.col("header_row") == each["header_row"]) & (F.col("delimiter") == each["delimiter"]))
            own = sorted(files.plain_path(r["file"]) for r in same.select("file").collect())
        parts.append(files.read_text_table(spark, own, row_order=row_order, checked=not infer, **(options | {"header_row": each["header_row"], "delimiter": each["delimiter"]})))
    if not parts:
        raise SanitizeError(f"no lines at {path!r}")
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return files.inferred(table) if infer else table


def write_table(df: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists", delimiter: str | None = None) -> None:
    kind = kind or format_of(path)
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "json":
        files.write_json(df, path, mode)
    else:
        files.write_delimited(df, path, delimiter or ("," if kind == "csv" else "\t"), mode)


def run_job(
    spark: SparkSession,
    source: str,
    output: str,
    columns: list[str] | None = None,
    steps: str | dict[str, Any] | list[Step] | None = None,
    read_options: dict[str, Any] | None = None,
    on_exists: str = "version",
    on_error: str = "fail",
    require_columns: bool = True,
    order_by: list[str] | None = None,
    audit_path: str | None = None,
    fingerprints: bool = True,
) -> DataFrame:
    """Run a job and return its audit record, one row; also appended at ``audit_path`` if given.

    The record is kept on failure too, before the error is raised again. Rows are counted from the
    output as written. A job that left out a failed step has status ``incomplete``, never ``success``. The source's fingerprint is taken before and after: if it changed while
    the job ran, the job fails.
    """
    started = datetime.now(timezone.utc)
    record: dict[str, Any] = {
        "job_id": uuid.uuid4().hex, "source_path": source, "output_path": output, "source_hash": "",
        "output_hash": "", "status": "error", "row_count": None, "column_count": None,
        "columns_selected": list(columns or []), "error_message": None, "summary": None, "steps": [],
    }
    try:
        if not exists(spark, source):
            raise SanitizeError(f"source {source!r} does not exist")
        target = safe_output(spark, source, output, on_exists)
        record["output_path"] = target
        if fingerprints:
            record["source_hash"] = files_fingerprint(spark, source)
        options = dict(read_options or {})
        todo = load_steps(steps) if steps else []
        # Steps that depend on the order of rows follow that of the files, unless told otherwise.
        in_file_order = order_by is None and any(map(needs_order, todo))
        table = read_table(spark, source, row_order=in_file_order, **options)
        if columns:
            table = select_columns(table, [*columns, *(ROW_ORDER if in_file_order else [])])
        data = table
        failed = False
        if steps:
            result = run_steps(table, todo, on_error, require_columns, ROW_ORDER if in_file_order else order_by)
            data, failed = result.data.drop(*ROW_ORDER) if in_file_order else result.data, not result.success
            record["steps"] = [r.asDict() for r in result.metrics().collect()]  # a row per step
            lines = [f"{'ok' if m['success'] else 'FAILED'} {m['step']}. {m['step_name']}: rows {m['rows_before']} -> {m['rows_after']}, columns {m['cols_before']} -> {m['cols_after']}" for m in record["steps"]]
            record["summary"] = "\n".join(lines)
        write_table(data, target, mode="overwrite" if on_exists == "replace" else "errorifexists", delimiter=options.get("delimiter"))
        check_written(spark, target, data)
        record["column_count"] = len(data.columns)
        record["row_count"] = _count_written(spark, target, data)
        if fingerprints:
            record["output_hash"] = files_fingerprint(spark, target)
            if files_fingerprint(spark, source) != record["source_hash"]:
                raise SanitizeError("the source changed while the job ran")
        record["status"] = "incomplete" if failed else "success"
    except KeyboardInterrupt:
        record["status"], record["error_message"] = "cancelled", "cancelled by the user"
        raise
    except Exception as exc:
        record["error_message"] = str(exc)
        raise
    finally:
        finished = datetime.now(timezone.utc)
        record |= {"started_at": started, "finished_at": finished, "duration_seconds": round((finished - started).total_seconds(), 3)}
        audit = audit_record(spark, record)
        if audit_path:
            audit.coalesce(1).write.mode("append").parquet(audit_path)
    return audit


def _count_written(spark: SparkSession, target: str, data: DataFrame) -> int:
    kind = format_of(target)
    if kind in ("csv", "txt"):  # written cells may hold line breaks, whatever the source was
        return spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(target).count()
    if kind == "json":
        return spark.read.schema(data.schema).json(target).count()
    return spark.read.parquet(target).count()


def audit_record(spark: SparkSession, record: dict[str, Any]) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in AUDIT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(record[n] for n in names)], AUDIT_SCHEMA)


def job_history(spark: SparkSession, audit_path: str) -> DataFrame:
    """All kept records, latest first."""
    return spark.read.schema(AUDIT_SCHEMA).parquet(audit_path).orderBy(F.col("started_at").desc(), "job_id")
