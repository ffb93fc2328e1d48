"""Compare a query with its DuckDB SQL: same columns, same rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(cols, found):
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(con, df, sql):
    cols = sorted(df.columns)
    got = rows(cols, [tuple(r) for r in df.select(*cols).collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = rows(cols, [tuple(r[i] for i in at) for r in result.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
