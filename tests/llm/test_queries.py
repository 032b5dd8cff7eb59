import pytest

from tests.parity import connect, same
from weftline.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    same(registry.queries()[name](spark, FOLDER), con, registry.oracle_sql()[name])


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    assert corpus_pipeline.run(spark, FOLDER).count() > 50
