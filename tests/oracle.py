"""Compare a query with its SQL in another engine, without regard to order."""

import math
from decimal import Decimal

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(found):
    return sorted((tuple(plain(x) for x in r) for r in found), key=repr)


def same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    df, want = query(spark, sf), con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert rows_of(df.select(*names).collect()) == rows_of(want.select(*[f'"{c}"' for c in names]).fetchall())
