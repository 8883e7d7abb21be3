"""Run a registered query and its SQL over the same tables and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return repr(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, sf_dir, query, sql, limit=5):
    """Empty if equal, else the first rows that only one side has."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return []
    left, right = set(got) - set(want), set(want) - set(got)
    return [("rows", len(got), len(want)), *[("spark", x) for x in sorted(left)[:limit]], *[("sql", x) for x in sorted(right)[:limit]]]
