"""Rows of a query and of its SQL counterpart on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con.sql(sql).df()


def check(spark, query, sql, sf_dir):
    got, want = query(spark, sf_dir).toPandas(), sql_rows(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return len(got)
