import pytest

from millrace.plans import relational
from oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(relational.queries()))
def test_matches_sql(spark, name):
    assert same(relational.queries()[name](spark, SF), SF, relational.oracle_sql()[name]) > 0
