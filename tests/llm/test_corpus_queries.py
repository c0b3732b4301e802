import pytest
from oracle import same

from corvata.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_one_query_an_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
