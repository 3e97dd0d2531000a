"""Compare a report with its SQL, column by column and row by row."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _rows(table: pa.Table) -> list[tuple]:
    columns = [table.column(name).to_pylist() for name in sorted(table.column_names)]
    rows = list(zip(*columns))
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


def _types(table: pa.Table) -> dict[str, str]:
    def kind(t: pa.DataType) -> str:
        if pa.types.is_large_string(t):
            return "string"
        return "timestamp" if pa.types.is_timestamp(t) and t.tz is None else str(t)

    return {field.name: kind(field.type) for field in table.schema}


def differences(spark_table: pa.Table, sql_table: pa.Table) -> list[str]:
    problems = []
    if _types(spark_table) != _types(sql_table):
        problems.append(f"types {_types(spark_table)} vs {_types(sql_table)}")
        if set(spark_table.column_names) != set(sql_table.column_names):
            return problems
    left, right = _rows(spark_table), _rows(sql_table)
    if len(left) != len(right):
        problems.append(f"{len(left)} rows vs {len(right)}")
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return problems
