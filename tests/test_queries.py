"""Every registered query against its oracle, and the shape of every plan."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()
# Cache hits: 1,000 events hold none, 10,000 do.
SPARSE = {"rag_08_cached_messages", "str_04_cached_answers"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name in ORACLES:
        assert differences(df, con, ORACLES[name], name in SPARSE) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
