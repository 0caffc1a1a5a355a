"""Each core query against its SQL on the smallest tables."""

import os
from pathlib import Path

import pytest

from millrace.plans import problems, reference

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
SQL = problems.SQL | reference.SQL
QUERIES = problems.QUERIES | reference.QUERIES


def rows(df):
    import pandas as pd

    df = df[sorted(df.columns)]
    plain = lambda x: None if pd.isna(x) else str(x) if isinstance(x, (str, bool)) or not hasattr(x, "__float__") else round(float(x), 6)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, str(DATA)).toPandas()) == rows(duck.sql(SQL[name]).df())
