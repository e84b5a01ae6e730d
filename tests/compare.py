"""Holds a Spark query against its DuckDB SQL, without regard to order."""

import glob
import math
import os

import duckdb


def rounded(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return [columns[i] for i in order], sorted((tuple(rounded(r[i]) for i in order) for r in rows), key=key)


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    r = con.sql(sql)
    return rows_of(list(r.columns), r.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
