"""Side-by-side comparison of a registered job with its DuckDB statement."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def sort_key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


def compare(df, con, sql) -> str | None:
    """None when equal, else a short account of the first difference."""
    cols = sorted(df.columns)
    spark_rows = sorted((tuple(canonical(r[c]) for c in cols) for r in df.collect()), key=sort_key)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    duck_rows = sorted((tuple(canonical(r[i]) for i in at) for r in res.fetchall()), key=sort_key)
    if len(spark_rows) != len(duck_rows):
        extra = list(set(map(str, spark_rows)) - set(map(str, duck_rows)))[:2]
        lacking = list(set(map(str, duck_rows)) - set(map(str, spark_rows)))[:2]
        return f"rows {len(spark_rows)} vs {len(duck_rows)}; only spark {extra}; only duckdb {lacking}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            return f"{cols}\n   spark  {a}\n   duckdb {b}"
    types = {d[0]: str(d[1]) for d in res.description}
    odd = [f"{c}:{df.schema[c].dataType.simpleString()}/{types[c]}" for c in cols
           if not _alike(df.schema[c].dataType.simpleString(), types[c])]
    if odd:
        return "types " + ", ".join(odd)
    return None


def _alike(spark_type: str, duck_type: str) -> bool:
    families = [({"string"}, {"VARCHAR", "STRING"}), ({"bigint"}, {"BIGINT", "HUGEINT", "NUMBER"}),
                ({"int", "smallint", "tinyint"}, {"INTEGER", "SMALLINT", "TINYINT"}),
                ({"double", "float"}, {"DOUBLE", "FLOAT"}), ({"boolean"}, {"BOOLEAN", "BOOL"}), ({"date"}, {"DATE"}),
                ({"timestamp", "timestamp_ntz"}, {"TIMESTAMP", "DATETIME"})]
    for left, right in families:
        if spark_type in left:
            return duck_type.upper() in right
    return True
