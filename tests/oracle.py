"""Runs a query in Spark and its SQL in DuckDB on the same tables."""

from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v if v is None or isinstance(v, (int, str)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([_plain(r[i]) for i in order]) for r in data)


def compare(spark, query, sql, folder):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = connect(folder).execute(sql)
    assert got == rows([c[0] for c in found.description], found.fetchall())
