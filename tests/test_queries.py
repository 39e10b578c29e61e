"""Every query of the engine against its SQL, on the smallest tables."""

import pytest

from sieveloom.plans import analytics, captions, curation, images  # noqa: F401
from sieveloom.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf_dir, duck, rows_of):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_without_subpackage(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
