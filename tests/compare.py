"""Run a registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _sortable(row: tuple) -> tuple:
    return tuple((value is None, str(value)) for value in row)


def spark_rows(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    rows = [tuple(row[c] for c in columns) for row in frame.select(*[f"`{c}`" for c in columns]).collect()]
    return columns, sorted(rows, key=_sortable)


def oracle_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(row[i] for i in order) for row in result.fetchall()]
    return [names[i] for i in order], sorted(rows, key=_sortable)


def same_value(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def assert_same(frame, con, sql: str) -> int:
    columns, got = spark_rows(frame)
    wanted_columns, wanted = oracle_rows(con, sql)
    assert columns == wanted_columns
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted):
        assert all(map(same_value, g, w)), (columns, g, w)
    return len(got)
