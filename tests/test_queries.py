"""Every registered query of the engine against its SQL in DuckDB."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from tracewright import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if hasattr(value, "tzinfo"):
        return str(value.replace(tzinfo=None))
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (int, bool)) or value is None:
        return value
    return str(value)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(range(len(names)), key=names.__getitem__)
        want = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
        key = lambda r: [(v is None, str(v)) for v in r]
        assert sorted(map(lambda r: tuple(float(v) if isinstance(v, int) else v for v in r), rows), key=key) == sorted(map(lambda r: tuple(float(v) if isinstance(v, (int,)) or hasattr(v, "as_integer_ratio") else v for v in r), want), key=key)


def test_flagship(spark, sf_dir):
    df = catalog.flagship(spark, sf_dir)
    assert df.count() > 0 and "chunk_id" in df.columns
