"""User-level jobs end to end on small inputs."""
import json
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sqlforge.plans import jobs as J
from sqlforge.session import register_tables

from conftest import SF_SMALL


def test_prepare_corpus_job(spark):
    d = tempfile.mkdtemp(prefix="sqlforge-job-")
    os.makedirs(f"{d}/db/shop")
    pq.write_table(pa.table({"item_id": [1], "name": ["a"]}), f"{d}/db/shop/items.parquet")
    json.dump([{"db_id": "shop", "question": "names?", "query": "SELECT name FROM items"},
               {"db_id": "shop", "question": "", "query": "SELECT 1"}], open(f"{d}/train.json", "w"))
    json.dump([{"db_id": "shop", "question": "ids?", "SQL": "SELECT item_id FROM items", "evidence": "e"}],
              open(f"{d}/dev.json", "w"))
    out = J.prepare_corpus(spark, [(f"{d}/train.json", "spider", "train", False),
                                   (f"{d}/dev.json", "bird", "dev", True)], f"{d}/db", out=f"{d}/sft")
    back = spark.read.json(f"{d}/sft")
    assert back.count() == 2
    user = back.filter(F.col("split") == "dev").first()["conversations"][0]["content"]
    assert "Table items: (item_id bigint, name string)" in user and "e" in user
    counts = {(r["source"], r["split"]): (r["n_raw"], r["n_kept"]) for r in out["counts"].collect()}
    assert counts == {("spider", "train"): (2, 1), ("bird", "dev"): (1, 1)}


def test_evaluate_and_score_jobs(spark):
    register_tables(spark, SF_SMALL, ("customer", "nation"))
    samples = spark.createDataFrame([
        (1, "sales", "q1", "", "simple", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
        (2, "sales", "q2", "", "hard", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC"),
        (3, "sales", "q3", "", "hard", "SELECT count(*) FROM customer")],
        "sample_id long, db_id string, question string, evidence string, difficulty string, query string")
    preds = spark.createDataFrame([(1, "select n_name from nation where n_regionkey = 1;"),
                                   (2, "SELECT c_custkey FROM customer ORDER BY c_custkey"),
                                   (3, "SELECT count(*) FROM customr")], "sample_id long, pred_sql string")
    res = J.evaluate(spark, samples, preds)
    det = {r["sample_id"]: (r["ex"], r["em"]) for r in res["details"].collect()}
    assert det == {1: (True, True), 2: (False, False), 3: (False, False)}
    scored = preds.join(samples.select("sample_id", F.col("query").alias("gold_sql")), "sample_id") \
        .withColumn("output", F.concat(F.lit("<summary>"), F.col("pred_sql"), F.lit("</summary>")))
    r = {x["sample_id"]: x for x in J.score(spark, scored).collect()}
    assert r[1]["r_exec"] == 1.0 and r[1]["r_syntax"] == 1.0
    assert r[3]["r_exec"] == 0.0 and r[3]["r_syntax"] == 0.5
    assert r[2]["r_exec"] == 1.0  # pred ordered: lists differ, but the token F1 of equal rows is 1


def test_report_feeds_reflection(spark, tmp_path):
    """J4 writes the report that J6 reads."""
    register_tables(spark, SF_SMALL, ("nation",))
    samples = spark.createDataFrame([(1, "sales", "q1", "", "simple", "SELECT n_name FROM nation"), (2, "sales", "q2", "e", "hard", "SELECT 1"),
                                     (3, "sales", "q3", "", "hard", "SELECT 2")],
                                    "sample_id long, db_id string, question string, evidence string, difficulty string, query string")
    preds = spark.createDataFrame([(1, "SELECT n_nam FROM nation"), (2, "SELECT 1"), (3, "SELECT id FROM range(50)")], "sample_id long, pred_sql string")
    J.evaluate(spark, samples, preds, out=str(tmp_path / "report"))
    got = {r["sample_id"]: r for r in J.reflection_inputs(spark, str(tmp_path / "report"), samples.withColumn("schema", F.lit("T"))).collect()}
    assert set(got) == {1, 3}
    assert "n_nam" in got[1]["exec_error"] and "n_name" in got[1]["prompt"]
    assert got[3]["exec_result"] == "[" + ", ".join(f"({k},)" for k in range(10)) + "]"
    assert [m["role"] for m in got[1]["messages"]] == ["system", "user"] and got[1]["flat"].endswith("Assistant:")


def test_training_log_of_epochs_and_runs(spark):
    rows = [(run, epoch, g, float((g * 7 + o * 3 + epoch) % 5), -0.1 * o, -0.2 * o)
            for run in (0, 1) for epoch in range(3) for g in range(100) for o in range(4)]
    df = spark.createDataFrame(rows, "run long, epoch int, group_id long, reward double, logp_new double, logp_ref double")
    log = J.rollout_statistics(df, epoch_col="epoch", run_col="run")["log"].collect()
    for run in (0, 1):
        own = sorted((r for r in log if r["run"] == run), key=lambda r: r["global_step"])
        assert [r["global_step"] for r in own] == [10, 20, 30]
        assert all((r["step"] + 1) % 8 == 0 and r["step"] < 100 for r in own) and len({r["epoch"] for r in own}) == 3
    assert J.rollout_statistics(df.filter("run = 0 AND epoch = 0"))["log"].count() == 1
