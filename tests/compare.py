"""Runs a query and its SQL and compares rows."""

import math
import os

import duckdb


def connect(sf: str):
    c = duckdb.connect()
    for t in sorted(os.listdir(sf)):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


def rows(records: list[dict]) -> list[tuple]:
    return sorted((tuple((k, plain(r[k])) for k in sorted(r)) for r in records), key=repr)


def spark_rows(df) -> list[tuple]:
    return rows([r.asDict() for r in df.collect()])


def sql_rows(c, sql: str) -> list[tuple]:
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return rows([dict(zip(names, x)) for x in r.fetchall()])
