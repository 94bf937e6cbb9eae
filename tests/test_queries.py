import os

import pytest

from pagewright.plans import problems, reference
from tests.oracle import same

DATA = "/root/testdata/sf0.001"
QUERIES = problems.QUERIES | reference.QUERIES
ORACLES = problems.ORACLES | reference.ORACLES


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], DATA)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
