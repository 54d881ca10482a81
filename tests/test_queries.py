from __future__ import annotations

import pytest

from compare import connect, same
from quillmill.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_duckdb(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), connect(sf), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
