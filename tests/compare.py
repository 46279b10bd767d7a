"""Compare a query with its SQL on the same tables, as the driver does."""

import datetime
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.date() if isinstance(v, datetime.datetime) else v


def same(df, sql, sf_dir):
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    order = sorted(names)
    got = sorted((tuple(_plain(r[n]) for n in order) for r in df.collect()), key=repr)
    at = [names.index(n) for n in order]
    expected = sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert len(got) == len(expected) and got == expected, (order, [(g, e) for g, e in zip(got, expected) if g != e][:3])
    return len(got)
