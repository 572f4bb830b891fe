"""Compare a Spark result with a DuckDB result: rows, column names, types, values."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def as_rows(table: pa.Table) -> Counter:
    names = sorted(table.column_names)
    return Counter(zip(*[map(repr, table[n].to_pylist()) for n in names], strict=True))


def kind(data_type: pa.DataType) -> str:
    return "string" if pa.types.is_large_string(data_type) else str(data_type)


def differences(spark_table: pa.Table, duck_table: pa.Table) -> list[str]:
    found = []
    if sorted(spark_table.column_names) != sorted(duck_table.column_names):
        return [f"columns {spark_table.column_names} and {duck_table.column_names}"]
    for name in spark_table.column_names:
        ours, theirs = (kind(t.schema.field(name).type) for t in (spark_table, duck_table))
        if ours != theirs:
            found.append(f"type of {name}: {ours} and {theirs}")
    ours, theirs = as_rows(spark_table), as_rows(duck_table)
    if ours != theirs:
        found.append(
            f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours "
            f"{list((ours - theirs).items())[:3]}, only theirs {list((theirs - ours).items())[:3]}"
        )
    return found
