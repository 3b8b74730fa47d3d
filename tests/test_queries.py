"""Every query of the engine itself against its SQL; those without SQL must run."""

import pytest
from loomspark.operators import registry

from parity import SF, check


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.ORACLES:
        check(spark, registry.QUERIES[name], registry.ORACLES[name])
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "grams8", "grams13", "several8"]
    assert set(e.oracle_sql()) <= set(e.queries())
