import pytest

from siftara.llm import queries
from tests.oracle import DATA, same, views


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test data here")
    return views()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    if name in queries.SQL:
        same(spark, con, queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, str(DATA)).limit(5).collect() is not None
