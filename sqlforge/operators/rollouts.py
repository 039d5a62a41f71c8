"""Reflection set and rollout-group statistics G1, G3-G9.

Rollouts are long-form ``(group_id, output_idx, reward, logp_new, logp_ref)``.
Per-group statistics use windows partitioned by group (a group is G outputs,
bounded). The training log needs positions in one global order; those come
from the distributed numbering in :mod:`ranking`, never from an unpartitioned
window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ADV_EPS, CLIP_EPS, FLAT_EPS, GRAD_ACCUM, KL_BETA, LOG_EVERY
from ..functions.prompts import reflection_flat, reflection_messages, reflection_prompt
from ..session import materialize
from .ranking import group_row_number

MAP_BUCKETS = 256      # of 32,768 bits each


def may_match(rows: DataFrame, wanted: DataFrame, col: str) -> DataFrame:
    """The rows whose ``col`` may be a value of ``wanted``: all that are, and few others.

    The values set bits of a map of ``MAP_BUCKETS`` x 32,768 bits, 1 MB whatever their number; it is built by aggregates with
    map-side combine, sent to the rows, and each row tests its bit. With so many values that the map is full, all rows pass.
    """
    place = F.pmod(F.xxhash64(col), F.lit(MAP_BUCKETS * 32_768))
    bucket, bit = F.floor(place / 32_768).cast("int"), F.pmod(place, F.lit(32_768)).cast("int")
    bits = wanted.filter(F.col(col).isNotNull()).select(bucket.alias("_bucket"), bit.cast("long").alias("_bit")) \
        .groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    # A bucket's bits are 4096 bytes, the bit of place p in byte p / 8 from the lowest bit up.
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit / 8 as int) + 1, 1)")), 16, 10).cast("int")
    tested = rows.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(materialize(bits, "question-map")), "_bucket") \
        .filter(F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod("_bit", F.lit(8)))), F.lit(2)) == 1)
    return tested.select(*rows.columns)


def reflection_set(stage1: DataFrame, corpus: DataFrame, only_wrong: bool = True,
                   order_col: str = "sample_id") -> DataFrame:
    """G1: drop correct rows (when ``only_wrong``); schema and evidence looked up by question text.

    On duplicate questions the last corpus row (largest ``order_col``) wins;
    no match gives ''. The lookup is an aggregate (max_by) plus a left join, over the corpus rows
    whose question may be wanted (:func:`may_match`): the texts of others aren't shuffled.
    """
    s = stage1.filter(~F.coalesce(F.col("ex"), F.lit(False))) if only_wrong else stage1
    lookup = may_match(corpus, s, "question").groupBy("question").agg(
        F.max_by(F.struct("schema", "evidence"), F.col(order_col)).alias("hit"))
    return (s.drop("schema", "evidence").join(lookup, "question", "left")
            .withColumn("schema", F.coalesce(F.col("hit.schema"), F.lit("")))
            .withColumn("evidence", F.coalesce(F.col("hit.evidence"), F.lit("")))
            .drop("hit"))


def with_reflection_prompt(df: DataFrame) -> DataFrame:
    """G3 on a table with question, schema, pred_sql, exec_result, exec_error, evidence: the user text
    (``prompt``), the chat form (``messages``) and the flat form (``flat``), both with the system text."""
    df = df.withColumn("prompt", reflection_prompt(F.col("question"), F.col("schema"), F.col("pred_sql"),
                                                   F.col("exec_result"), F.col("exec_error"), F.col("evidence")))
    return df.withColumn("messages", reflection_messages("prompt")).withColumn("flat", reflection_flat("prompt"))


def _keys(group: str | list[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def group_advantage(rollouts: DataFrame, group: str | list[str] = "group_id", reward: str = "reward") -> DataFrame:
    """(r - mean) / (population std + 1e-8) inside each group."""
    w = Window.partitionBy(*_keys(group))
    return rollouts.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) /
                               (F.stddev_pop(reward).over(w) + F.lit(ADV_EPS)))


def with_flat_flag(rollouts: DataFrame, group: str | list[str] = "group_id", reward: str = "reward") -> DataFrame:
    w = Window.partitionBy(*_keys(group))
    return rollouts.withColumn("flat", (F.max(reward).over(w) - F.min(reward).over(w)) < F.lit(FLAT_EPS))


def informative_groups(rollouts: DataFrame, group: str | list[str] = "group_id") -> DataFrame:
    """Drop groups whose rewards are all equal (max - min < 1e-6), then rows with |advantage| < 1e-6."""
    r = group_advantage(with_flat_flag(rollouts, group), group)
    return r.filter(~F.col("flat") & (F.abs("advantage") >= F.lit(FLAT_EPS))).drop("flat")


def clipped_objective(rollouts: DataFrame, eps: float = CLIP_EPS, beta: float = KL_BETA,
                      group: str | list[str] = "group_id") -> DataFrame:
    """Per non-flat group, sum over informative outputs of
    -min(ratio * A, clip(ratio, 1-eps, 1+eps) * A) + beta * (new - ref), divided by all outputs of the group."""
    r = group_advantage(with_flat_flag(rollouts, group), group)
    n_all = F.count(F.lit(1)).over(Window.partitionBy(*_keys(group)))
    diff = F.col("logp_new") - F.col("logp_ref")
    ratio = F.exp(diff)
    clipped = F.least(F.greatest(ratio, F.lit(1.0 - eps)), F.lit(1.0 + eps))
    term = -F.least(ratio * F.col("advantage"), clipped * F.col("advantage")) + F.lit(beta) * diff
    r = r.withColumn("n_all", n_all).filter(~F.col("flat"))
    return r.groupBy(*_keys(group)).agg(
        (F.sum(F.when(F.abs("advantage") >= F.lit(FLAT_EPS), term).otherwise(F.lit(0.0))) /
         F.first("n_all")).alias("loss"))


def group_rewards(rollouts: DataFrame, group: str | list[str] = "group_id", reward: str = "reward",
                  keep: list[str] | None = None) -> DataFrame:
    """Mean reward and flat flag per group; ``keep`` columns (constant in a group) stay."""
    kept = [F.min(c).alias(c) for c in keep or [] if c not in _keys(group)]
    return rollouts.groupBy(*_keys(group)).agg(F.avg(reward).alias("mean_reward"),
                                               ((F.max(reward) - F.min(reward)) < F.lit(FLAT_EPS)).alias("flat"), *kept)


def training_log(rollouts: DataFrame, order_cols: list[str] | None = None, group: str = "group_id",
                 accum: int = GRAD_ACCUM, every: int = LOG_EVERY, epoch_col: str | None = None,
                 run_col: str | None = None) -> DataFrame:
    """Logging points of the update loop.

    Groups are visited in ``order_cols`` order (default: group id), one per
    step; a group that recurs in another epoch or run is a visit of its own. The step restarts per epoch, the
    update counter and the reward log do not; runs are separate. An update happens where (step + 1) % accum
    == 0 and the group was not skipped as flat; every ``every``-th update reports the mean of the last
    ``every`` group means (skipped groups included) and that step's loss.
    """
    order_cols = order_cols or [group]
    if epoch_col is None:
        rollouts, epoch_col = rollouts.withColumn("epoch", F.lit(0)), "epoch"
    runs = [run_col] if run_col else []
    keys = [*runs, epoch_col, group]
    per = group_rewards(rollouts, keys, keep=order_cols).join(clipped_objective(rollouts, group=keys), keys, "left")
    seq = group_row_number(per, runs, [epoch_col, *order_cols, group], "seq")
    # One row per epoch, written once: its size is known, so the steps aren't dealt by epoch for it.
    first = materialize(seq.groupBy(*runs, epoch_col).agg(F.min("seq").alias("_s0")), "epoch-starts")
    seq = seq.join(first, [*runs, epoch_col]).withColumn("step", F.col("seq") - F.col("_s0")).drop("_s0")
    upd = seq.filter(~F.col("flat") & (((F.col("step") + 1) % accum) == 0))
    upd = group_row_number(upd, runs, ["seq"], "global_step")
    logs = upd.filter(F.col("global_step") % every == 0)
    window = logs.select(*runs, "global_step", F.explode(F.sequence(F.col("seq") - (every - 1), F.col("seq"))).alias("s"))
    past = seq.select(*runs, F.col("seq").alias("s"), F.col("mean_reward").alias("mr"))
    avg = window.join(past, [*runs, "s"]).groupBy(*runs, "global_step").agg((F.sum("mr") / F.lit(float(every))).alias("avg_reward"))
    return logs.join(avg, [*runs, "global_step"]).select(
        *runs, "global_step", epoch_col, "step", group, F.round("avg_reward", 9).alias("avg_reward"),
        F.round("loss", 9).alias("loss"))
