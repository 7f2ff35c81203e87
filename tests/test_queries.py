"""Every registered query beside its SQL, at the smallest size."""

from pathlib import Path

import duckdb
import pytest

from siftstone import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for file in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return c


def test_flagship(spark):
    assert catalog.flagship(spark, str(SF)).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, str(SF)).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda t: sorted(map(tuple, t[columns].astype(str).to_numpy().tolist()))
    assert tidy(got) == tidy(want)
