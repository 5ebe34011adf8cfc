"""Every query of the library against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from landgrain.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    # NaN and NULL are both missing here.
    rows = lambda df: sorted(repr([None if pd.isna(x) else x for x in r]) for r in df[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
