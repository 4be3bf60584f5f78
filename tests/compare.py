"""A query's rows against those of its SQL."""

import os

import duckdb


def differs(spark, query, sql, data):
    """What is different, or null."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    df = query(spark, data)
    columns = sorted(df.columns)
    rel = con.sql(sql)
    if columns != sorted(rel.columns):
        return f"columns {columns} and {sorted(rel.columns)}"
    rows = lambda found: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found), key=repr)
    got, want = rows(df.select(*columns).collect()), rows(rel.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    near = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a)))
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    return next((f"{a} and {b}" for a, b in zip(got, want, strict=True) if not all(map(near, a, b))), None)
