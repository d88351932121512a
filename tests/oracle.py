"""Rows of a Spark query and of its DuckDB SQL in one comparable form."""

import decimal
import glob

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)
