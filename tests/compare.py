"""Spark results against DuckDB's, as sets of rows by column name."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def assert_same(df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    expected = rows_of(names, result.fetchall())
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert found == expected
