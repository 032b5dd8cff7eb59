import pytest

from tests.parity import connect, same
from weftline import registry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    same(registry.queries()[name](spark, FOLDER), con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(NAMES)))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert set(found.columns) == {"doc1", "doc2", "n_shared", "jaccard"} and found.count() > 0
