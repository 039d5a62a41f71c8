"""Reward rules with literal expectations, including every empty-side rule."""
from pyspark.sql import functions as F

from sqlforge.functions import text as TX
from sqlforge.operators import rewards as RW


def one(spark, pred, gold, fn):
    df = spark.createDataFrame([(pred, gold)], "p string, g string")
    return df.select(fn(F.col("p"), F.col("g")).alias("r")).first()["r"]


def test_schema_tokens(spark):
    df = spark.createDataFrame([("SELECT t.name, COUNT(*) FROM users AS t WHERE t.city = 'New York' AND x = \"q z\"",)], "s string")
    toks = sorted(df.select(TX.schema_tokens("s").alias("t")).first()["t"])
    assert toks == ["city", "name", "users"]


def test_reward_schema_rules(spark):
    assert one(spark, "", "", RW.reward_schema) == 1.0          # gold empty, pred empty
    assert one(spark, "SELECT a1", "", RW.reward_schema) == 0.5  # gold empty, pred not
    assert one(spark, "", "SELECT a1", RW.reward_schema) == 0.0  # pred empty
    assert one(spark, "SELECT aa, bb FROM tt", "SELECT aa FROM tt", RW.reward_schema) == 2 / 3


def test_reward_ngram_rules(spark):
    long = " ".join(f"w{k % 7000}" for k in range(20000))
    df = spark.createDataFrame([
        (1, "", ""), (2, "select a", "one"),    # gold has no bigram, pred has
        (3, "x", "select a"),                   # pred has none
        (4, "select a from t", "select a from u"),  # 2 of 3 bigrams shared both ways
        (5, None, None), (6, "a a a a", "a a"), (7, long, long)], "sample_id long, pred_sql string, gold_sql string")
    got = {r["sample_id"]: r["r_ngram"] for r in RW.reward_ngram(df).collect()}
    assert {k: round(v, 12) for k, v in got.items()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: round(2 / 3, 12), 5: 1.0, 6: 0.5, 7: 1.0}


def _rows(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, side string, row_no int, cells array<string>, row_str string")


def test_result_f1_empty_sides(spark):
    samples = spark.createDataFrame([(i,) for i in range(1, 6)], "sample_id long")
    rows = _rows(spark, [
        (2, "pred", 1, ["a"], "('a',)"),                       # gold empty, pred not -> 0
        (3, "gold", 1, ["a b"], "('a b',)"), (3, "pred", 1, ["a c"], "('a c',)"),  # 1 of 2 both ways -> 0.5
        (4, "gold", 1, [None], "(None,)"), (4, "pred", 1, ["NONE"], "('NONE',)"),  # NULL is token 'none'
        (5, "gold", 1, [""], "('',)"), (5, "pred", 1, [""], "('',)"),              # both token-less -> 1
    ])
    got = {r["sample_id"]: r["f1"] for r in RW.result_token_f1(rows, samples).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.5, 4: 1.0, 5: 1.0}


def test_reward_total_weights(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0), (0.0, 1.0, 0.5, 0.0, 0.0)],
                               "r_exec double, r_format double, r_syntax double, r_schema double, r_ngram double")
    got = [r["r_total"] for r in RW.reward_total(df).collect()]
    assert abs(got[0] - 1.0) < 1e-12 and abs(got[1] - (0.1 + 0.05) / 1.5) < 1e-12


def test_reward_ngram_texts_of_one_key_count_together_and_no_gram_is_a_row(spark):
    df = spark.createDataFrame([(1, "a b", "b c"), (1, "b c b c", "a b"), (2, "a b a b c", "a b c a"), (None, "x y", "x y")],
                               "sample_id long, pred_sql string, gold_sql string")
    out = RW.reward_ngram(df)
    got = {r["sample_id"]: round(r["r_ngram"], 12) for r in out.collect()}
    # 1: pred {ab 1, bc 2, cb 1}, gold {bc 1, ab 1}; 2: pred {ab 2, ba 1, bc 1}, gold {ab 1, bc 1, ca 1}
    assert got == {1: round(2 * (2 / 4) * 1 / (2 / 4 + 1), 12), 2: round(2 * (2 / 4) * (2 / 3) / (2 / 4 + 2 / 3), 12), None: 1.0}
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_reward_execution_counts_cells_only_where_rows_differ(spark, monkeypatch):
    seen = []
    counted = RW.result_token_f1

    def watched(rows, samples):
        seen.append({r["sample_id"] for r in rows.select("sample_id").collect()})
        return counted(rows, samples)
    monkeypatch.setattr(RW, "result_token_f1", watched)
    rows = _rows(spark, [(s, side, 1, [f"a {side if s in (2, 3) else 'b'}"], f"('a {side if s in (2, 3) else 'b'}',)") for s in (1, 2, 3) for side in ("pred", "gold")]
                 + [(5, "gold", 1, ["a"], "('a',)")])
    status = spark.createDataFrame([(s, side, "error" if (s, side) == (3, "pred") else "ok", "select 1") for s in (1, 2, 3, 4, 5) for side in ("pred", "gold")]
                                   + [(6, "pred", "ok", None)], "sample_id long, side string, status string, sql string")
    got = {r["sample_id"]: r["r_exec"] for r in RW.reward_execution(rows, status).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.0, 4: 1.0, 5: 0.0, 6: 0.0} and seen == [{2, 5}]
