"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(directory):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else (int(v) if v.is_integer() else repr(round(v, 9)))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(df, con, sql):
    """'' when equal, else what differs."""
    left = normalized(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right = normalized([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows against {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1], strict=True) if a != b]
    return f"{len(bad)} of {len(left[1])} rows differ: {left[0]} {bad[:3]}" if bad else ""
