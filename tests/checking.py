"""Compares a Spark query with its checking SQL run by DuckDB over the same files."""

from __future__ import annotations

import math

import duckdb

from siteferry.plans.inputs import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, float):
        return "f:nan" if math.isnan(value) else f"f:{value!r}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return f"s:{value}"


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(str([canonical(r[n]) for n in names]) for r in df.collect())


def rows_of_sql(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(str([canonical(r[i]) for i in order]) for r in result.fetchall())


def compare(df, con, sql) -> str | None:
    """None when both agree, else a short account of the difference."""
    names, mine = rows_of_spark(df)
    wanted_names, wanted = rows_of_sql(con, sql)
    if names != wanted_names:
        return f"columns {names} against {wanted_names}"
    if mine == wanted:
        return None
    a, b = set(mine) - set(wanted), set(wanted) - set(mine)
    return f"{len(mine)} rows against {len(wanted)}; only ours {sorted(a)[:3]}; only theirs {sorted(b)[:3]}"
