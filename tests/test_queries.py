import pytest

from quern.plans import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, same, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])
