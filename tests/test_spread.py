"""Short rows that become long texts are dealt to many tasks; the steps of a training log aren't dealt by epoch."""

from pyspark.sql import functions as F

from sqlforge.fixtures import fixture
from sqlforge.operators.rollouts import training_log
from sqlforge.session import spread


def customers(spark, path, n):
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")) \
        .coalesce(1).write.parquet(f"{path}/customer.parquet")


def test_texts_are_made_in_tasks_of_bounded_rows(spark, tmp_path):
    customers(spark, str(tmp_path), 25_000)
    pairs = fixture(spark, str(tmp_path), "pairs")
    sizes = [r["n"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 25_000 and len(sizes) == 3 and max(sizes) < 10_000
    assert pairs.select("sample_id").distinct().count() == 25_000


def test_few_rows_stay_where_they_are(spark):
    df = spark.range(100).coalesce(1)
    assert spread(df) is df and sorted(r.id for r in spread(df, 30).collect()) == list(range(100))


def test_steps_are_not_dealt_by_epoch(spark):
    rows = [(g, o, float((g * 7 + o) % 5), -0.1 * o, -0.2) for g in range(200) for o in range(3)]
    log = training_log(spark.createDataFrame(rows, "group_id long, output_idx int, reward double, logp_new double, logp_ref double"))
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(epoch" not in plan
