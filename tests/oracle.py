"""Compare a Spark result with DuckDB's on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_norm(r[n]) for n in names) for r in df.collect())


def rows_of_duckdb(con, sql):
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted(tuple(_norm(r[i]) for i in at) for r in got.fetchall())
