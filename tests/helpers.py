"""Comparison of query results with DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir=DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def same_rows(df, con, sql):
    """Both results as sorted rows of plain values, columns by name."""
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    con.execute(sql)
    columns = [d[0] for d in con.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    want = sorted(repr([plain(float(v) if type(v).__name__ == "Decimal" else v) for v in (r[k] for k in order)]) for r in con.fetchall())
    assert len(got) == len(want)
    assert got == want
