"""Holds a query against its SQL in DuckDB: the same columns and the same rows, in any order."""

from __future__ import annotations

import math
import os

import duckdb

DATA = os.environ.get("SEQPACK_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql, data=DATA):
    df = query(spark, data)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    rel = con.sql(sql)
    expected = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    assert len(got) == len(expected), (len(got), len(expected))
    wrong = [(g, e) for g, e in zip(got, expected, strict=True) if g != e]
    assert not wrong, (len(wrong), wrong[:3])
    return len(got)
