import pytest

from quarry.llm import registry
from tests.llm.compare import same


@pytest.mark.parametrize("name", ["op8_ngram_join", "op9_decontaminate", "op12_ranked_search"])
def test_query_against_sql(spark, sf_dir, name):
    assert same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir) > 0
