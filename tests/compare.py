"""Compare registered queries with their SQL on DuckDB, value by value."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(normal(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


FAMILIES = {
    "tinyint": "int", "smallint": "int", "integer": "int", "bigint": "bigint",
    "varchar": "string", "boolean": "boolean", "double": "double", "hugeint": "hugeint",
}


def compare(spark, con, name, run, sql, sf_dir) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    got = df.collect()
    rel = con.sql(sql)
    names, types = rel.columns, [str(t).lower() for t in rel.types]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_types = dict(df.dtypes)
    odd = {
        n: (spark_types[n], t) for n, t in zip(names, types)
        if FAMILIES.get(t, t) != spark_types[n]
    }
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:1]
        return f"{len(a)} rows vs {len(b)}; first difference: {str(bad)[:600]}"
    return f"types {odd}" if odd else None


def main() -> None:
    import __spark_entry__ as e
    from mailweave.session import build_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    sqls = e.oracle_sql()
    for name, run in e.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, run, sqls[name], sf_dir) or "ok"
            else:
                problem = f"rows {run(spark, sf_dir).count()}"
        except Exception as exc:  # noqa: BLE001
            problem = f"ERROR {type(exc).__name__}: {str(exc)[:500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {problem}", flush=True)


if __name__ == "__main__":
    main()
