"""A task's share of a shuffle does not grow with the tables, however few shuffle partitions the session names."""

from pyspark.sql import functions as F

from linkloom.session import PART_BYTES, SHUFFLE_PARTS, fine_shuffles


def test_shuffles_are_cut_finely_and_small_parts_put_together(spark):
    fine_shuffles(spark)
    found = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f", {SHUFFLE_PARTS})" in plan
    assert sorted(tuple(r) for r in found.collect()) == [(k, 100) for k in range(10)]


def test_a_task_is_given_few_shuffled_bytes(spark):
    """Spark joins small parts up to 64 MB otherwise, which are most of a gigabyte of pages and edges in memory."""
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    fine_shuffles(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == PART_BYTES
    assert int(PART_BYTES.removesuffix("m")) <= 8
