import pytest

from siftara.plans import basics, corpus, evaluation, general, judging, pipelines, records, sequences
from tests.oracle import DATA, same, views

PLANS = [general, corpus, judging, records, evaluation, basics, pipelines, sequences]
CASES = [(name, plan) for plan in PLANS for name in plan.QUERIES]


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test data here")
    return views()


@pytest.mark.parametrize(("name", "plan"), CASES, ids=[n for n, _ in CASES])
def test_query(spark, con, name, plan):
    if name in plan.SQL:
        same(spark, con, plan.QUERIES[name], plan.SQL[name])
    else:
        assert plan.QUERIES[name](spark, str(DATA)).limit(5).collect() is not None
