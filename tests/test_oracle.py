"""Every query of the library against its SQL; those without SQL must run and give rows."""

from __future__ import annotations

import pytest
from cinefold.plans import catalog
from compare import SMALL, connection, same

CON = connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, name):
    assert same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE_SQL[name], CON)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
