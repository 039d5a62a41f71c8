"""Properties over the fixtures."""
from pyspark.sql import functions as F

import __spark_entry__ as E

from conftest import SF_SMALL


def test_round_trip_flat_templates(spark):
    rows = {r["shape"]: (r["n_same"], r["n"]) for r in E.queries()["round_trip"](spark, SF_SMALL).collect()}
    for shape in (0, 1, 2, 3, 4):
        n_same, n = rows[shape]
        assert n_same == n, (shape, rows[shape])


def test_rewards_in_unit_interval(spark):
    df = E.queries()["reward_total"](spark, SF_SMALL)
    for c in ("r_exec", "r_format", "r_syntax", "r_schema", "r_ngram", "r_total"):
        assert df.filter((F.col(c) < 0) | (F.col(c) > 1)).count() == 0, c


def test_execution_match_implies_full_f1(spark):
    ex = E.queries()["execution_match"](spark, SF_SMALL)
    f1 = E.queries()["result_f1"](spark, SF_SMALL)
    assert ex.join(f1, "sample_id").filter(F.col("ex") & (F.col("f1") < 1.0)).count() == 0
    assert ex.filter("ex").count() > 0 and ex.filter("NOT ex").count() > 0


def test_advantages_sum_to_zero(spark):
    adv = E.queries()["group_advantage"](spark, SF_SMALL)
    s = adv.groupBy("group_id").agg(F.sum("advantage").alias("s"))
    assert s.filter(F.abs("s") > 1e-4).count() == 0
