"""Every registered ledger query against its oracle on the smoke tables."""

import duckdb
import pytest

from ledgerloom.plans import catalog

from .conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_oracle(spark, duck, tmp_path, name):
    catalog.queries()[name](spark, SF001).write.parquet(str(tmp_path / "out"))
    expected = duck.execute(catalog.oracle_sql()[name]).df()
    got = duck.execute(f"select * from '{tmp_path}/out/*.parquet'").df() if any((tmp_path / "out").glob("*.parquet")) else expected.head(0)
    columns = sorted(expected.columns)
    assert columns == sorted(got.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert rows(got) == rows(expected)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
