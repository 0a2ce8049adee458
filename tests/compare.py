"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, bool) or v is None:
            return repr(v)
        if isinstance(v, float):
            return "None" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
        return str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in frame_rows), sorted(columns)


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    return rows_of(found.fetchall(), [d[0] for d in found.description]) + ([str(d[1]) for d in sorted(found.description)],)


def spark_rows(df):
    return rows_of([tuple(r) for r in df.collect()], df.columns) + ([df.schema[c].dataType.simpleString() for c in sorted(df.columns)],)
