"""Every query with a SQL twin gives the same rows as DuckDB on the same files."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def cell(value):
    return value.isoformat() if hasattr(value, "isoformat") else value


def ordered(columns, rows):
    """Columns by name; rows by their exact values first, then by rounded numbers."""
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(cell(r[i]) for i in places) for r in rows]
    return sorted(plain, key=lambda r: (
        repr([None if isinstance(v, float) else v for v in r]), repr([f"{v:.3f}" if isinstance(v, float) else "" for v in r])))


def same(got, want):
    if isinstance(got, float) and want is not None:
        return abs(got - float(want)) <= 1e-6 * max(1.0, abs(got))
    return got == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    got, want = ordered(frame.columns, frame.collect()), ordered(columns, cursor.fetchall())
    assert len(got) == len(want)
    different = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    assert different == []


def test_every_key_is_registered():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
