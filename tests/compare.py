"""Rows of a Spark query and of DuckDB SQL, in a form that can be compared."""

import os

import duckdb


def tables(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows_of_duckdb(con, sql: str):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v
