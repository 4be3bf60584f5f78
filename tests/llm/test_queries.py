"""The registered queries of this part against their SQL on the smallest tables."""

import os

import pytest

from tests.compare import differs
from trellisway.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    assert differs(spark, QUERIES[name], ORACLES[name], DATA) is None
