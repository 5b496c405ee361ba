"""Side-by-side check of a catalogue query and its SQL."""

from __future__ import annotations

import math
from pathlib import Path

from loomlight.catalog.registry import Query

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            connection.execute(
                f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
            )
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(f"{value:.9g}"))
    if isinstance(value, bool) or value is None:
        return repr(value)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


_KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def differences(entry: Query, spark, folder: str, built=None) -> list[str]:
    """Empty when the query gives the rows and types of its SQL."""
    built = entry.build(spark, folder) if built is None else built
    got_names = built.columns
    got_kinds = {n: _KINDS.get(k, k) for n, k in built.dtypes}
    got = _rows(got_names, [tuple(r) for r in built.collect()])
    if entry.sql is None:
        return [] if got else ["no rows"]
    cursor = duck(folder).execute(entry.sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = _rows(names, cursor.fetchall())
    problems = []
    if sorted(names) != sorted(got_names):
        problems.append(f"columns {sorted(got_names)} != {sorted(names)}")
    odd = {
        n: (got_kinds[n], kinds[n]) for n in names if n in got_kinds and got_kinds[n] != kinds[n]
    }
    if odd:
        problems.append(f"types {odd}")
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    if not expected:
        problems.append("the SQL gives no rows")
    if not problems and got != expected:
        a, b = set(got), set(expected)
        problems.append(
            f"{len(a - b)} rows differ: got {sorted(a - b)[:2]} wanted {sorted(b - a)[:2]}"
        )
    return problems
