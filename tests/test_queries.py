import pytest

import __spark_entry__
from lodestar.queries import ORACLE, QUERIES

from .oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, small, name):
    check(spark, QUERIES[name], ORACLE[name], small)


def test_registry():
    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).count() > 0
