import pytest

from posewright.llm.queries import ORACLES, QUERIES
from tests.oracle import expected, found


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, sf, name):
    assert found(QUERIES[name](spark, sf)) == expected(ORACLES[name], sf)
