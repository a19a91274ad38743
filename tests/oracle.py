"""Runs a query beside its SQL in DuckDB and compares rows, order and column order aside."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v + 0.0, ".6g") if v else "0"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, int):
        return format(float(v), ".6g") if abs(v) < 10**5 else str(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return repr(v)


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v.asDict(True) if hasattr(v, "asDict") else v) for v in r) for r in df.select(cols).collect())
    rel = con.execute(f"with q as ({sql}) select * from q") if not sql.lstrip().lower().startswith("with") else con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return ""
    a, b = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} rows and {len(want)}; only here {sorted(a)[:3]}; only there {sorted(b)[:3]}"
