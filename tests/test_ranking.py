"""Distributed in-group numbering equals row_number, also with one hot group."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from sqlforge.operators.ranking import global_row_number, group_row_number


def test_group_row_number_matches_window(spark):
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),  # group 0 holds a third
        (F.col("id") * 7919 % 1000).alias("v"), F.col("id"))
    got = group_row_number(df, ["g"], ["v", "id"], "pos", num_partitions=16)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    diff = got.select("g", "id", "pos").exceptAll(want.select("g", "id", F.col("pos").cast("long")))
    assert diff.count() == 0 and got.count() == 20000


def test_global_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 37 % 5000).alias("k"))
    got = global_row_number(df, ["k"], "seq", num_partitions=8)
    assert got.filter(F.col("seq") != F.col("k") + 1).count() == 0


def test_groups_over_several_partitions_nulls_and_small_groups(spark):
    df = spark.range(0, 6000).select(
        F.when(F.col("id") < 3000, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("g"),
        (F.col("id") % 2).alias("h"), F.col("id"))
    got = group_row_number(df, ["g", "h"], ["id"], "pos", num_partitions=24)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g", "h").orderBy("id")).cast("long"))
    assert got.exceptAll(want).count() == 0 and got.count() == 6000
    assert group_row_number(df.limit(0), ["g"], ["id"], "pos").count() == 0


def test_numbering_never_joins_on_the_group(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id"))
    plan = group_row_number(df, ["g"], ["id"], "pos")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert "hashpartitioning(g#" not in plan
