"""Row numbers inside groups without sending a whole group to one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` puts every row of a group
into one task; with one group holding a third of the data that task is the
job. Here rows are range-partitioned on (g, o, tiebreak) instead, so a big
group is spread over many partitions, and positions are a prefix scan over the
partitions: a row's number is its place among the group's rows of its own
partition plus the group's rows of all partitions before.

Rows lie in order, so only the first group of a partition can have begun
earlier. The scan therefore carries one row per partition (its first and last
group and how many rows the last one has there) and nothing per group. The place
inside a partition is a window over (partition, group), a key that one partition holds;
rows are never joined back on the group. The result equals ``row_number()`` exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_LOCAL_BITS = 33


def group_row_number(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "pos",
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its group, ordered by ``order_cols``.

    ``order_cols`` must make the order total within a group (add a unique
    tiebreak column), otherwise equal keys are numbered in an arbitrary order,
    as with ``row_number``.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in list(group_cols) + list(order_cols)]
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    # The range bounds are sampled per evaluation, so the tagged rows are
    # written once (shared checkpoint folder) and every branch below reads the
    # same ids. Written data also survives executor loss.
    tagged = materialize(ordered.withColumn("_mid", mid), "numbering") \
        .withColumn("_pid", F.shiftright(F.col("_mid"), _LOCAL_BITS)) \
        .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    if not group_cols:
        # One row per partition: safe to order globally.
        counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
        return tagged.join(F.broadcast(offsets), "_pid").withColumn(name, (F.col("_off") + F.col("_loc") + 1).cast("long")) \
            .drop("_mid", "_pid", "_loc", "_off")
    local = F.row_number().over(Window.partitionBy("_pid", *group_cols).orderBy("_loc"))
    return tagged.withColumn("_here", local).join(F.broadcast(_carried(tagged, group_cols)), "_pid") \
        .withColumn(name, (F.col("_here") + F.when(F.struct(*group_cols).eqNullSafe(F.col("_first")), F.col("_carry"))
                           .otherwise(F.lit(0))).cast("long")) \
        .drop("_mid", "_pid", "_loc", "_here", "_first", "_carry")


def _carried(tagged: DataFrame, group_cols: list[str]) -> DataFrame:
    """(_pid, _first, _carry), one row per partition: its first group and that group's rows in earlier partitions."""
    g = F.struct(*group_cols)
    ends = tagged.groupBy("_pid").agg(F.min_by(g, "_loc").alias("_first"), F.max_by(g, "_loc").alias("_last"))
    tails = tagged.select("_pid", g.alias("_g")).join(F.broadcast(ends), "_pid") \
        .groupBy("_pid").agg(F.any_value("_first").alias("_first"), F.any_value("_last").alias("_last"),
                             F.count_if(F.col("_g").eqNullSafe(F.col("_last"))).alias("_tail"))
    order = Window.orderBy("_pid")          # one row per partition
    run = F.sum("_tail").over(Window.partitionBy("_last").orderBy("_pid"))
    before = tails.withColumn("_run", run) \
        .withColumn("_prev", F.lag(F.struct("_last", "_run")).over(order))
    same = F.col("_prev").isNotNull() & F.col("_prev._last").eqNullSafe(F.col("_first"))
    return before.select("_pid", "_first", F.when(same, F.col("_prev._run")).otherwise(F.lit(0)).alias("_carry"))


def global_row_number(df: DataFrame, order_cols: list, name: str = "seq",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based position of every row in one global order (no single-partition window)."""
    return group_row_number(df, [], order_cols, name, num_partitions)
