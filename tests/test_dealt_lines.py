from pyspark.sql import functions as F

from zonalis.plans import inputs


def test_lines_are_worked_out_over_all_cores(spark, sf):
    """The join that makes identities ends in few partitions; lines are worked out after they are dealt."""
    made = inputs.lines(spark, sf).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(made) >= spark.sparkContext.defaultParallelism
