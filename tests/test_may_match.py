"""The bit map keeps every wanted row and few others; the reflection set is the same with it."""
from pyspark.sql import functions as F

from sqlforge.operators import rollouts as RO


def test_all_wanted_rows_pass_and_few_others(spark):
    rows = spark.range(0, 20_000).select(F.col("id"), F.concat(F.lit("question é "), F.col("id")).alias("question"), F.lit("t").alias("schema"))
    wanted = rows.filter("id % 10 = 3").select("question").union(spark.createDataFrame([(None,), ("",)], "question string"))
    got = RO.may_match(rows.union(spark.createDataFrame([(-1, None, "t"), (-2, "", "t")], "id long, question string, schema string")), wanted, "question")
    ids = {r.id for r in got.collect()}
    assert {k for k in range(20_000) if k % 10 == 3} | {-2} <= ids and -1 not in ids
    assert len(ids) < 2001 + 40 and got.columns == rows.columns
    assert RO.may_match(rows, wanted.limit(0), "question").count() == 0


def test_reflection_set_against_a_dictionary(spark):
    corpus = spark.createDataFrame([(k, f"q{k % 30}", f"s{k}", f"e{k}") for k in range(90)] + [(200, None, "s", "e")], "sample_id long, question string, schema string, evidence string")
    stage1 = spark.createDataFrame([(k, f"q{k}", k % 2 == 0) for k in range(25, 40)] + [(99, None, False)], "detail_ord long, question string, ex boolean")
    got = {r.detail_ord: (r.schema, r.evidence) for r in RO.reflection_set(stage1, corpus).collect()}
    last = {f"q{k % 30}": (f"s{k}", f"e{k}") for k in range(90)}
    assert got == {k: last.get(f"q{k}", ("", "")) for k in range(25, 40) if k % 2} | {99: ("", "")}
