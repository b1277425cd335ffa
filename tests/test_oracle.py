"""Every core query against its SQL on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from corpusflow.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 10**9 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, engine, name):
    df = catalog.queries()[name](spark, str(FOLDER))
    cursor = engine.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    found = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert found == sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert catalog.queries()[name](spark, str(FOLDER)).count() > 0
