"""Run a registered query and its SQL check and compare them as sorted rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def spark_rows(df):
    return sorted(df.columns), _sorted([tuple(r) for r in df.collect()], df.columns)


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), _sorted(cur.fetchall(), columns)


SPARK_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
               "timestamp_ntz": "TIMESTAMP"}


def kinds(con, df, sql):
    """Column types of both sides, Spark's written as DuckDB's."""
    spark = {f.name: SPARK_KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
             for f in df.schema.fields}
    duck = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return spark, duck


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
