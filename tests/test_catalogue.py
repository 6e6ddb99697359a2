import pytest

from tests.oracle import assert_same
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLES:
        assert_same(df, catalogue.ORACLES[name], SF)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as engine

    assert engine.entry(spark).count() > 0
    assert set(engine.oracle_sql()) <= set(engine.queries())
