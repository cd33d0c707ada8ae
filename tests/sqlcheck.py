"""Rows of a query and of its SQL, in one order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c.sql(sql).fetchdf()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value) or str(value) in ("NaT", "<NA>", "nan"):
        return None
    if hasattr(value, "date") and str(value).endswith("00:00:00"):
        return str(value)[:10]
    return round(float(value), 9) if isinstance(value, float) or type(value).__name__ in ("Decimal", "float64", "float32") else str(value)


def ordered(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(plain(v) for v in row) for row in frame[cols].itertuples(index=False, name=None)), key=repr)
