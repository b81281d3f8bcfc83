"""A query's rows beside its SQL's, on the same parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, int):
        return f"{float(x):.9g}" if abs(x) < 1 << 50 else str(x)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(x, list | tuple):
        return "[" + ", ".join(map(plain, x)) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(f"{k}: {plain(v)}" for k, v in sorted(x.items())) + "}"
    return str(x)


def differences(spark, run, sql: str, sf_dir: str = SF_DIR) -> list[str]:
    """What is wrong: column names, or up to three rows of each side that the other lacks; nothing if they agree."""
    got = run(spark, sf_dir)
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    if sorted(names) != sorted(got.columns):
        return [f"columns {sorted(got.columns)} against {sorted(names)}"]
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in (x.asDict(recursive=True) for x in got.collect()))
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    if a == b:
        return []
    left, right = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return [f"{order}", f"{len(a)} rows against {len(b)}", *[f"query only {x}" for x in left], *[f"SQL only {x}" for x in right]]
