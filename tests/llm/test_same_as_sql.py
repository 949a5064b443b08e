import oracle
import pytest

from zonalis.llm import queries


@pytest.mark.parametrize("name", ["op11_lloyd", "op12_license_scan", "op13_spelling_variants"])
def test_same_as_sql(spark, sf, name):
    assert oracle.compare(spark, queries.QUERIES, queries.ORACLE_SQL, sf, name) is None
