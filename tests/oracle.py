"""Holds a query against its DuckDB SQL: same columns, same rows in any order."""

import os
from collections import Counter
from numbers import Number

import duckdb


def _cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    return repr(float(v)) if isinstance(v, Number) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], Counter(tuple(_cell(r[k]) for k in order) for r in rows)


def differ(df, sql, sf_dir):
    with duckdb.connect() as c:
        for t in os.listdir(sf_dir):
            c.execute(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
        found = c.sql(sql)
        want = _rows(found.columns, found.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    return list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3]
