"""Rows of a Spark result and a DuckDB result in one form."""

import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def form(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(int(v))) if v == int(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(form, v)) + "]"
    return str(v)


def connection(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def assert_same(df, connection, sql):
    rows, columns = df.collect(), sorted(df.columns)
    found = connection.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    mine = sorted(tuple(form(r[c]) for c in columns) for r in rows)
    other = sorted(tuple(form(r[i]) for i in at) for r in found.fetchall())
    assert mine == other
    assert mine, "an empty result proves nothing"
