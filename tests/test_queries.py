import oracle
import pytest

from zonalis.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert oracle.compare(spark, catalogue.QUERIES, catalogue.ORACLE_SQL, sf, name) is None


def test_pages_are_read(spark, sf):
    from zonalis.plans import inputs

    read = catalogue.QUERIES["read_pipeline"](spark, sf).join(inputs.lines(spark, sf).selectExpr("c_custkey", "line1 AS t1", "line2 AS t2"), "c_custkey")
    right = read.selectExpr("avg(CAST(line1 = t1 AS INT)) AS a", "avg(CAST(line2 = t2 AS INT)) AS b").first()
    assert right["a"] > 0.7 and right["b"] > 0.7


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())
