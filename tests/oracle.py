"""Run a query and its SQL over the same tables and compare all values, by type."""

import os

import duckdb
import pyarrow as pa
import pyarrow.types as kinds

SF = "/root/testdata/sf0.001"


def connection(folder: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def kind(of: pa.DataType) -> str:
    """What a column holds, whatever its width: an integer is no float, and a boolean is neither."""
    if kinds.is_list(of) or kinds.is_large_list(of):
        return f"list of {kind(of.value_type)}"
    if kinds.is_struct(of):
        return "struct of " + ", ".join(f"{f.name} {kind(f.type)}" for f in of)
    told = {"boolean": kinds.is_boolean, "integer": kinds.is_integer, "floating": kinds.is_floating, "decimal": kinds.is_decimal, "date": kinds.is_date, "timestamp": kinds.is_timestamp, "binary": kinds.is_binary}
    return next((name for name, holds in told.items() if holds(of)), "string" if kinds.is_string(of) or kinds.is_large_string(of) else str(of))


def _cell(x):
    """A value with an order; only the last digits of floats are left out."""
    if x is None:
        return (0,)
    if isinstance(x, float):
        return (1, round(x, 9) + 0.0 if x == x else "nan")
    if isinstance(x, list):
        return (1, tuple(_cell(y) for y in x))
    if isinstance(x, dict):
        return (1, tuple(_cell(y) for y in x.values()))
    return (1, x)


def table(rows: pa.Table) -> tuple[list[tuple[str, str]], list[tuple]]:
    names = sorted(rows.column_names)
    columns = [[_cell(x) for x in rows.column(c).to_pylist()] for c in names]
    return [(c, kind(rows.schema.field(c).type)) for c in names], sorted(zip(*columns, strict=True))


def same(spark, query, sql: str, folder: str = SF) -> None:
    mine, theirs = table(query(spark, folder).toArrow()), table(connection(folder).sql(sql).to_arrow_table())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]
