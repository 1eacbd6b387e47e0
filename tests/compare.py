"""Compare a Spark result with the DuckDB result of its SQL."""

from __future__ import annotations

import duckdb

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else v) for v in row)


def sorted_rows(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(picked, key=_key)


def spark_rows(df):
    return sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(db, sql: str):
    result = db.execute(sql)
    return sorted_rows([d[0] for d in result.description], result.fetchall())


# Spark type name -> DuckDB type names that mean the same.
SAME_TYPE = {
    "string": {"VARCHAR"},
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
}


def type_mismatches(df, db, sql: str) -> list[str]:
    described = {r[0]: r[1] for r in db.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{name}: {kind} / {described.get(name)}"
        for name, kind in df.dtypes
        if described.get(name) not in SAME_TYPE.get(kind, set())
    ]
