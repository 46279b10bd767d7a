"""Compare a query with its SQL on the same tables, as the driver does."""

import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(values):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values), key=repr)


def same(df, sql, sf_dir):
    con = duck(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = rows(tuple(r[n] for n in sorted(names)) for r in df.collect())
    order = [names.index(n) for n in sorted(names)]
    expected = rows(tuple(r[i] for i in order) for r in cur.fetchall())
    assert got == expected, [(g, e) for g, e in zip(got, expected) if g != e][:3]
    return len(got)
