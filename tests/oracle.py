"""Spark's rows against DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, sf: str) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr(tuple(r[i] for i in order)) for r in got.fetchall())), [names[i] for i in order]


def rows_of_spark(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(repr(tuple(r)) for r in df.select(*names).collect()), names
