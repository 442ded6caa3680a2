"""Run a registered query on Spark and its SQL on DuckDB and compare the two results as multisets."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """One spelling of a value for both engines."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, decimal.Decimal):
        return ("d", str(value))
    if isinstance(value, float):
        return ("f", f"{value:.9g}")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = found.fetchall()
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both agree, else a short description."""
    names, got = spark_rows(df)
    want_names, want = duck_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"{sum(got.values())} rows, wanted {sum(want.values())}; {sum(extra.values())} differ; columns {names}\n"
            f"  got  {list(extra)[:2]}\n  want {list(missing)[:2]}"
        )
    return None if got else "no rows"
