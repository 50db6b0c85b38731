import pytest

from arcweave.llm import catalog
from tests.llm.conftest import close


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, query, oracle):
    (columns, rows), (named, expected) = query(name), oracle(name)
    assert columns == named
    assert close(rows) == close(expected)
