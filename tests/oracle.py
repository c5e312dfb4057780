"""Rows of a query and of its SQL in a form that can be compared."""

import glob
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet({sorted(glob.glob(path + '/*.parquet')) or [path]})")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.10g}"
    if hasattr(x, "replace") and hasattr(x, "tzinfo"):
        return str(x.replace(tzinfo=None))
    return str(x)


def rows(table):
    names = sorted(table.column_names)
    return sorted((tuple(plain(v) for v in r) for r in zip(*[table.column(n).to_pylist() for n in names])), key=repr), names
