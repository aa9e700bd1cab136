import pytest

from millrace.llm import registry
from oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert same(registry.queries()[name](spark, SF), SF, registry.oracle_sql()[name]) > 0
