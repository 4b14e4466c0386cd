import pytest

import oracle
from trellis.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    oracle.compare(QUERIES[name](spark, sf), con, ORACLE_SQL[name])


def test_comparison_can_fail(spark, con):
    with pytest.raises(AssertionError):
        oracle.compare(spark.sql("select 1 as a"), con, "select 2 as a")
