"""Runs a query and its SQL side by side and compares the rows without their order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows(names, got.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect())


def differences(df, sql: str, sf_dir: str) -> list:
    """What differs, at most a few rows; empty if nothing does."""
    names, mine = spark_rows(df)
    others, theirs = sql_rows(sql, sf_dir)
    if names != others:
        return [names, others]
    if len(mine) != len(theirs):
        return [f"{len(mine)} rows", f"{len(theirs)} rows", *(set(map(repr, mine)) ^ set(map(repr, theirs)))][:6]
    return [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b][:3]
