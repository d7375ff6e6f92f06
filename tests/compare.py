"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import math

import duckdb

from geodemand.sources.tables import BASE_TABLES


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, f"{round(v, 6):.6f}")
    if isinstance(v, (list, tuple)):
        return (3, repr([norm(x) for x in v]))
    return (5, str(v))


def duck(sf_dir):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same(df, con, sql):
    names = sorted(df.columns)
    rows = sorted(tuple(norm(r[n]) for n in names) for r in df.collect())
    rel = con.sql(sql)
    cols = rel.columns
    assert sorted(cols) == names, (cols, names)
    drows = sorted(tuple(norm(r[cols.index(n)]) for n in names) for r in rel.fetchall())
    assert len(rows) == len(drows), (len(rows), len(drows))
    assert rows == drows
