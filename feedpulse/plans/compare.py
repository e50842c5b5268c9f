"""Order-insensitive comparison of Spark rows with DuckDB oracle rows."""

from __future__ import annotations

import math


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, float):
        if math.isnan(v):
            return (2, "nan")
        return (1, f"{round(v, 6):.6f}")
    if isinstance(v, int):
        return (1, f"{float(v):.6f}")
    if hasattr(v, "isoformat"):
        return (3, v.isoformat()[:26])
    if isinstance(v, (list, tuple)):
        return (4, str([norm(x) for x in v]))
    return (5, str(v))


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in records)


def connect_duckdb(sf_dir: str):
    import duckdb
    from feedpulse.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


# Spark simple type names -> DuckDB type names, for schema comparison
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
                 "array<string>": "VARCHAR[]", "float": "FLOAT", "smallint": "SMALLINT"}


def spark_types(df) -> dict:
    return {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
