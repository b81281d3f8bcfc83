import pytest

from mizan.llm import registry
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_its_sqls_rows(spark, name):
    assert differences(spark, registry.queries()[name], registry.oracle_sql()[name]) == []
