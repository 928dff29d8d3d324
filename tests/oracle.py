"""Runs a registered query in Spark and its SQL in DuckDB, and gives both results as sorted rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


def rows_of(names, columns, rows):
    order = [columns.index(c) for c in names]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def both(spark, sf, query, sql):
    df = query(spark, sf)
    cur = connect(sf).execute(sql)
    columns = [d[0] for d in cur.description]
    names = sorted(df.columns)
    assert names == sorted(columns)
    return rows_of(names, df.columns, df.collect()), rows_of(names, columns, cur.fetchall())
