"""Comparing a query with its DuckDB twin."""

import decimal

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return None if v != v else float(v)
    if v is None or isinstance(v, (bool, int)):
        return v
    return str(v)


def compared(spark, sf_dir, run, sql):
    """(rows of the query, rows of the twin), by column name, sorted."""
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    own = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    return own, sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
