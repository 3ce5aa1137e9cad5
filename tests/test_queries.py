"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from emberline.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("lineitem", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def text_of(df):
    show = lambda v: "None" if v is None or v != v else repr(float(v)) if isinstance(v, (float, np.floating)) else str(v)
    out = df[sorted(df.columns)].astype(object).map(show)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert len(found)
    if name in catalogue.ORACLE:
        expected = duck.sql(catalogue.ORACLE[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert text_of(found).equals(text_of(expected))


def test_entry_works():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(catalogue.ORACLE) <= set(entry.oracle_sql())
