"""Results of a query and of its SQL, in one form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def check(spark, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    r = connection(folder).execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
