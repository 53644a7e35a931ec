"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from tempora import queries

DATA = Path(os.environ.get("TEMPORA_TESTDATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)
