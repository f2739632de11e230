"""Run a registered query and its oracle and compare rows regardless of order."""

from __future__ import annotations

import math
import os

import duckdb

from doclattice.plans.registry import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{os.path.join(folder, name)}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, sorted(rows, key=_key), {c: t for c, t in df.dtypes}


def oracle_rows(con, sql):
    rel = con.sql(sql)
    names = list(rel.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    return [names[i] for i in order], sorted(rows, key=_key), dict(zip(names, map(str, rel.types)))


SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def differences(df, con, sql, may_be_empty: bool = False) -> list[str]:
    """Empty when columns, types and rows agree (and, as a rule, there are rows)."""
    sc, sr, st = spark_rows(df)
    oc, orows, ot = oracle_rows(con, sql)
    out = []
    if sc != oc:
        return [f"columns {sc} != {oc}"]
    for c in sc:
        want = SAME.get(st[c])
        if want is None or want != ot[c]:
            out.append(f"type of {c}: {st[c]} vs {ot[c]}")
    if len(sr) != len(orows):
        out.append(f"rows {len(sr)} != {len(orows)}")
    bad = 0
    for a, b in zip(sr, orows):
        if a != b:
            bad += 1
            if bad <= 2:
                out.append(f"  spark {str(a)[:600]}\n  duck  {str(b)[:600]}")
    if bad:
        out.append(f"{bad} rows differ")
    if not out and not sr and not may_be_empty:
        out.append("no rows at all")
    return out
