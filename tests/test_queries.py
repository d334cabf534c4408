"""Every query that SQL can express against DuckDB, the others for shape and a few known facts."""

import os

import pytest

from mnemoria import registry
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck(SF).execute(registry.oracle_sql()[name]).df()
    same(got, want)


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).toPandas().shape[0] > 0


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
