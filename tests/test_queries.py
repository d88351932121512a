"""Every registered query that has SQL gives the same rows as DuckDB; the others run."""

import pytest
from oracle import connect, duck_rows, spark_rows

from lectern import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.ORACLES:
        assert spark_rows(df) == duck_rows(con, plans.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
