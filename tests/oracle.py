"""A query's rows against DuckDB's, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


def compare(spark, query, sql, folder):
    con = duckdb.connect(config={"max_temp_directory_size": "2GB", "memory_limit": "8GB"})
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [list(found.columns).index(c) for c in columns]
    want = sorted("|".join(_plain(r[i]) for i in at) for r in found.fetchall())
    got = sorted("|".join(_plain(r[c]) for c in columns) for r in frame.collect())
    assert got == want
