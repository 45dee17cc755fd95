import pytest

from tests.oracle import compare
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    compare(spark, SF, queries.queries()[name], queries.oracle_sql()[name])
