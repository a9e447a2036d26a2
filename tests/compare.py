"""Order-free comparison of a query's rows with those of its SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows(names: list[str], found) -> list[str]:
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> bool:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    return rows(df.columns, df.collect()) == rows(names, result.fetchall())
