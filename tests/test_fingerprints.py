"""Row fingerprints settle mismatches only; equal lists always reach the exact comparison."""
import random
from collections import Counter

from pyspark.sql import functions as F

from sqlforge.operators import evaluate as EV


def result_rows(seed, samples):
    r = random.Random(seed)
    out = []
    for s in range(samples):
        pred = [str(r.randint(0, 3)) for _ in range(r.randint(0, 5))]
        gold = list(pred) if s % 3 else [str(r.randint(0, 3)) for _ in range(r.randint(0, 5))]
        if s % 3 == 1:
            r.shuffle(gold)
        out += [(s, side, n, t) for side, texts in (("pred", pred), ("gold", gold)) for n, t in enumerate(texts, 1)]
    return out


def test_against_multisets_and_lists(spark):
    data = result_rows(2, 120)
    rows = spark.createDataFrame(data, "sample_id long, side string, row_no int, row_str string")
    sides = {(s, side): [t for a, b, _, t in data if (a, b) == (s, side)] for s in range(120) for side in ("pred", "gold")}
    maybe = {r.sample_id: r.maybe for r in EV.fingerprint_match(rows).collect()}
    have = {s for s, *_ in data}
    assert maybe == {s: Counter(sides[s, "pred"]) == Counter(sides[s, "gold"]) for s in have}
    sql = {0: ("q", "q"), 1: ("q order by 1", "q order by 1"), 2: ("q order by 1", "q"), 3: ("q", "q order by 1")}
    status = spark.createDataFrame([(s, side, "ok", sql[s % 4][k]) for s in range(120) for k, side in enumerate(("pred", "gold"))],
                                   "sample_id long, side string, status string, sql string")
    got = {r.sample_id: r.ex for r in EV.execution_match(rows, status).collect()}
    for s in range(120):
        p, g = ([x if "order" in sql[s % 4][k] else sorted(x) for k, x in enumerate((sides[s, "pred"], sides[s, "gold"]))])
        assert got[s] == (p == g), s


def test_only_equal_fingerprints_reach_the_comparison(spark, monkeypatch):
    rows = spark.range(0, 4000).select((F.col("id") % 40).alias("sample_id"), F.when(F.col("id") % 80 < 40, "pred").otherwise("gold").alias("side"),
                                       F.col("id").cast("int").alias("row_no"), F.when(F.col("id") % 40 < 10, "x").otherwise(F.col("id").cast("string")).alias("row_str"))
    status = spark.range(0, 80).select((F.col("id") % 40).alias("sample_id"), F.when(F.col("id") < 40, "pred").otherwise("gold").alias("side"),
                                       F.lit("ok").alias("status"), F.lit("q").alias("sql"))
    seen = []
    real = EV._equal_lists
    monkeypatch.setattr(EV, "_equal_lists", lambda r, p: seen.append(r.count()) or real(r, p))
    out = EV.execution_match(rows, status)
    assert out.filter("ex").count() == 10 and sum(seen) == 1000
