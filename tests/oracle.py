"""Compares a registered query with its SQL in DuckDB, rows sorted, columns by name."""

import decimal
import glob
import math
import os

import duckdb


def _value(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    if hasattr(x, "asDict"):
        return tuple(map(_value, x))
    if isinstance(x, dict):
        return tuple(sorted((k, _value(v)) for k, v in x.items()))
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    with duckdb.connect() as db:
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            files = f"{path}/*.parquet" if os.path.isdir(path) else path
            db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        want = _rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    return next((f"row {i}: {a} and {b}" for i, (a, b) in enumerate(zip(got, want, strict=True)) if a != b), None)
