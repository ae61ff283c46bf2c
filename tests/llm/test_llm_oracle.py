"""Every query of the subpackage with a SQL twin gives the same rows as DuckDB."""

from pathlib import Path

import duckdb
import pytest

from deployrisk.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    cursor = duck.execute(SQL[name])
    columns = sorted(d[0] for d in cursor.description)
    assert sorted(frame.columns) == columns
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in frame.collect())))
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, (tuple(dict(zip(names, r))[c] for c in columns) for r in cursor.fetchall())))
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want) if g != w] == []
