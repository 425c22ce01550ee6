"""Run a registered query and its oracle on the same tables and compare their rows."""

from __future__ import annotations

import decimal
import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT", "date": "DATE", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]",
}


def rows_of_spark(df):
    order = sorted(df.columns)
    return [(c, KINDS.get(dict(df.dtypes)[c], dict(df.dtypes)[c])) for c in order], [
        tuple(plain(r[c]) for c in order) for r in df.collect()
    ]


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    cur = con.execute(sql)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [(names[i], kinds[names[i]]) for i in order], [
        tuple(plain(r[i]) for i in order) for r in cur.fetchall()
    ]


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def difference(spark_side, sql_side) -> str | None:
    (s_schema, s_rows), (d_schema, d_rows) = spark_side, sql_side
    if s_schema != d_schema:
        return f"schema: spark {s_schema} sql {d_schema}"
    if len(s_rows) != len(d_rows):
        return f"rows: spark {len(s_rows)} sql {len(d_rows)}"
    a, b = sorted(s_rows, key=key), sorted(d_rows, key=key)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: spark {bad[0][0]} sql {bad[0][1]}"
    return None
