import pytest
from oracle import compare, connection

from verdigris.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    compare(queries.queries()[name](spark, sf_dir), connection(sf_dir), queries.ORACLES[name])
