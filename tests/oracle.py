"""Compare a registered query with its SQL on the smallest data."""

import os
from collections import Counter

import duckdb


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def same(spark, query, sql: str, d: str) -> None:
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    df = query(spark, d)
    rows = [r.asDict() for r in df.collect()]
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(norm(dict(zip(names, row, strict=True))[c]) for c in sorted(names)) for row in r.fetchall())
    assert Counter(tuple(norm(x[c]) for c in sorted(names)) for x in rows) == want
