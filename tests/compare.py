"""Runs a catalogue query on Spark and its SQL on DuckDB and compares the rows."""

import glob
import math
import os

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"create view {name} as select * from '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark, con, query, sf_dir):
    """Empty string when equal, else a description of the first difference."""
    df = query.run(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(_cell(r[n]) for n in names) for r in df.collect()]
    if query.sql is None:
        return ""
    rel = con.sql(query.sql)
    if sorted(rel.columns) != names:
        return f"columns {names} vs {sorted(rel.columns)}"
    spark_types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema}
    sql_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    wrong = {n: (spark_types[n], sql_types[n]) for n in names if spark_types[n] != sql_types[n]}
    if wrong:
        return f"types {wrong}"
    order = [rel.columns.index(n) for n in names]
    want = [tuple(_cell(r[i]) for i in order) for r in rel.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for a, b in zip(_sorted(got), _sorted(want)):
        if a != b and not all(
            x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6))
            for x, y in zip(a, b)
        ):
            return f"{dict(zip(names, a))} vs {dict(zip(names, b))}"
    return ""
