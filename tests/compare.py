"""Run registered queries against their SQL on the same tables and report differences.

Usage: python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from gatelane.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, fn, sql: str | None):
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return "rows", len(rows), None
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    rel = con.sql(sql)
    want_cols, want = rel.columns, rel.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return "columns", len(rows), (sorted(df.columns), sorted(want_cols))
    types = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    mine = dict(df.dtypes)
    bad = [(c, mine[c], str(t)) for c, t in zip(want_cols, rel.types) if types.get(mine[c], str(t)) != str(t)]
    got, want = rows_of(df.columns, rows), rows_of(want_cols, want)
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return "values", (len(got), len(want)), (sorted(df.columns), diff)
    if bad:
        return "types", len(rows), bad
    return "ok", len(rows), None


def main(argv):
    from gatelane.catalog import all_queries, all_sql

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, sql = all_queries(), all_sql()
    names = argv[1:] or list(queries)
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            state, count, detail = compare(spark, sf_dir, queries[name], sql.get(name))
        except Exception as error:  # report and go on with the next query
            state, count, detail = "ERROR", 0, str(error)[:1500]
        print(f"{state:8} {name:28} {count!s:>14} {time.time() - start:6.2f}s", "" if detail is None else detail, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
