import os

import pytest

from pagewright.llm import queries as q
from tests.oracle import same

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, q.QUERIES[name], q.ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_query_runs(spark, name):
    assert q.QUERIES[name](spark, DATA).count() > 0
