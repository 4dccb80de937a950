"""Comparing a query with its SQL twin, as the driver does: columns by name, rows without order."""

import os

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def text(value):
    return "~" if value is None else repr(round(value, 6)) if isinstance(value, float) else str(value)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(text(r[n]) for n in names) for r in df.collect())


def twin_rows(db, sql):
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in found.fetchall())
