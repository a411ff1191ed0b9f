"""Every registered query against its SQL twin."""

import os

import pytest

from __spark_entry__ import entry
from contentloom.plans import registered_queries as queries, registered_sql as oracle_sql
from oracle import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PLANS, SQLS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query_equals_twin(spark, duck, name):
    text, _ = differences(spark, duck, FOLDER, PLANS[name], SQLS.get(name))
    assert text == ""


def test_every_query_has_a_twin():
    assert set(SQLS) <= set(PLANS)
    assert not set(PLANS) - set(SQLS)


def test_entry(spark):
    assert entry(spark).count() > 0
