"""Holds a query's rows against its SQL, which DuckDB runs on the same files."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, list | tuple):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return [plain(y) for y in x.values()]
    if isinstance(x, decimal.Decimal):
        return repr(float(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def compare(df, c, sql):
    names = sorted(df.columns)
    order = lambda rows: sorted(rows, key=lambda r: [str(x) for x in r])
    got = order([plain(r[n]) for n in names] for r in df.collect())
    found = c.sql(sql)
    kinds = dict(zip(found.columns, map(str, found.types), strict=True))
    assert sorted(found.columns) == names
    assert {n: KINDS.get(k, kinds[n]) for n, k in df.dtypes} == kinds
    at = [found.columns.index(n) for n in names]
    assert got == order([plain(r[i]) for i in at] for r in found.fetchall())
