"""Run queries on Spark and their SQL on DuckDB, and compare the rows whatever their order."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def database(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(value)
    return value if isinstance(value, (str, bool)) else str(value)


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, query, sql: str | None) -> str:
    """Empty if all is well, else what is wrong."""
    df = query(spark, folder)
    ours = df.collect()
    if sql is None:
        return "" if ours else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} against {names}"
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    if a != b:
        return f"{len(ours)} rows against {len(theirs)}; ours only {list((a - b))[:3]}, theirs only {list((b - a))[:3]}"
    return "" if ours else "no rows"


def main() -> int:
    from tests.session import session

    import __spark_entry__ as entry

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), database(folder)
    wanted, sql, bad = sys.argv[1:], entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, query, sql.get(name))
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(problem)
        print(f"{'ok ' if not problem else 'BAD'} {name} {'' if name in sql else '(rows only) '}{time.time() - start:.2f}s {problem[:1800]}", flush=True)
    print(f"{bad} bad")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
