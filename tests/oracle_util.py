"""Compares a query with its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, found) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def differences(df, con, sql: str) -> list[str]:
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(sql)
    theirs = rows(result.columns, result.fetchall())
    out = []
    if sorted(df.columns) != sorted(result.columns):
        out.append(f"columns {sorted(df.columns)} and {sorted(result.columns)}")
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} and {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    out += [f"{len(bad)} differ, first {bad[0]}"] if bad else []
    return out
