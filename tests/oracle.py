"""Compare a query with its SQL in DuckDB over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) and any(f.endswith('.parquet') for f in os.listdir(path)) else ''}')")
    return con


def plain(v):
    return float(v) if type(v).__name__ == "Decimal" else round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    found = con.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    got = rows_of(df.columns, df.collect())
    return got, want
