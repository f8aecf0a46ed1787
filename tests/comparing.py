"""Rows of a query and of its SQL, in one comparable form."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v) -> str:
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


def spark_rows(df) -> list:
    cols = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(c, sql: str) -> tuple[list, list]:
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    cols = sorted(names)
    at = [names.index(x) for x in cols]
    return cols, sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
