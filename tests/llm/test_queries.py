"""Every query of the package runs on the smallest tables; those with SQL agree with it."""

from pathlib import Path

import duckdb
import pytest

from corpusflow.llm import queries

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, str(FOLDER))
    rows = df.collect()
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for f in FOLDER.glob("*.parquet"):
            con.execute(f"create view {f.stem} as select * from '{f}'")
        cursor = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        text = lambda v: f"{v:.9g}" if isinstance(v, float | int) else str(v)
        assert sorted(tuple(text(r[c]) for c in names) for r in rows) == sorted(tuple(map(text, r)) for r in cursor.fetchall())
