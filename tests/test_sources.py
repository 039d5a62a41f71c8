"""Sources and sinks S1-S8 round trips in a scratch folder."""
import json
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sqlforge.operators.corpus import build_sft, unify_corpora, with_clauses
from sqlforge.sources import catalog as CAT
from sqlforge.sources import io as IO


def _tmp():
    return tempfile.mkdtemp(prefix="sqlforge-test-")


def test_qa_json_variants(spark):
    d = _tmp()
    a = [{"db_id": "x", "question": "q1", "query": "SELECT 1"}, {"db_id": "x", "question": "q2"}]
    b = [{"db_id": "y", "question": "q3", "SQL": "SELECT 3", "evidence": "e", "difficulty": "simple"},
         {"db_id": "y", "question": "q4", "query": "SELECT 4"}, {"db_id": "y", "question": "q5"}]
    json.dump(a, open(f"{d}/a.json", "w"), indent=2)
    json.dump(b, open(f"{d}/b.json", "w"), indent=2)
    s1 = IO.read_qa_json(spark, f"{d}/a.json", "spider")
    s2 = IO.read_qa_json(spark, f"{d}/b.json", "bird", with_evidence=True)
    assert [r["query"] for r in s1.orderBy("sample_id").collect()] == ["SELECT 1", ""]
    got = [(r["query"], r["evidence"], r["difficulty"]) for r in s2.orderBy("sample_id").collect()]
    assert got == [("SELECT 3", "e", "simple"), ("SELECT 4", "", ""), ("", "", "")]
    u = unify_corpora(s1, s2)
    assert u.count() == 5 and u.filter(F.col("evidence").isNull()).count() == 0


def test_missing_path_gives_no_rows(spark):
    assert IO.read_qa_json(spark, "/nonexistent/x.json", "spider").count() == 0
    assert IO.read_jsonl(spark, "/nonexistent/y.jsonl").count() == 0


def test_jsonl_round_trip_with_blank_lines(spark):
    d = _tmp()
    with open(f"{d}/t.jsonl", "w", encoding="utf-8") as f:
        f.write(json.dumps({"system": "s", "conversations": [{"role": "user", "content": "été"}],
                            "db_id": "x", "source": "s", "query": "SELECT 1"}, ensure_ascii=False) + "\n\n\n")
        f.write(json.dumps({"system": "s2", "conversations": [], "db_id": "y", "source": "s", "query": ""}) + "\n")
    df = IO.read_jsonl(spark, f"{d}/t.jsonl")
    assert df.count() == 2
    assert df.orderBy("system").first()["conversations"][0]["content"] == "été"


def test_write_split_and_report(spark):
    d = _tmp()
    samples = spark.createDataFrame([(1, "s", "train", "x", "q", "SELECT a FROM t", "", ""),
                                     (2, "s", "dev", "x", "q2", "SELECT b FROM t", "", "")],
                                    IO.SAMPLE_SCHEMA).withColumn("schema", F.lit(""))
    sft = build_sft(with_clauses(samples))
    IO.write_split(sft, f"{d}/sft")
    assert sorted(n for n in os.listdir(f"{d}/sft") if n.startswith("split=")) == ["split=dev", "split=train"]
    back = spark.read.json(f"{d}/sft")
    assert back.count() == 2
    report = {"ex": 0.5, "em": 0.5, "details": [
        {"db_id": "x", "question": "q", "evidence": "", "difficulty": "", "gold_sql": "g", "pred_sql": "p", "ex": True, "em": False},
        {"db_id": "x", "question": "q2", "evidence": "", "difficulty": "", "gold_sql": "g", "pred_sql": "p", "ex": False, "em": False}]}
    json.dump(report, open(f"{d}/r.json", "w"), indent=2)
    det = IO.read_stage1(spark, f"{d}/r.json")
    assert det.count() == 2 and det.filter("ex").count() == 1
    IO.write_eval_report(det, det.groupBy().count(), f"{d}/report")
    assert spark.read.json(f"{d}/report/details").count() == 2


def test_scan_catalog_with_unreadable_database(spark):
    d = _tmp()
    for db, tables in {"shop": {"items": {"item_id": [1], "name": ["a"]}, "buyers": {"buyer_id": [1]}},
                       "school": {"pupils": {"pupil_id": [1], "age": [9]}}}.items():
        os.makedirs(f"{d}/{db}")
        for t, cols in tables.items():
            pq.write_table(pa.table(cols), f"{d}/{db}/{t}.parquet")
    os.makedirs(f"{d}/broken")
    open(f"{d}/broken/bad.parquet", "w").write("not parquet")
    cat = CAT.scan_catalog(spark, d, pks={"items": "item_id"})
    rows = [(r["db_id"], r["table_name"], r["col_name"], r["is_pk"]) for r in cat.orderBy("db_ord", "table_ord", "col_ord").collect()]
    assert rows == [("school", "pupils", "pupil_id", False), ("school", "pupils", "age", False),
                    ("shop", "buyers", "buyer_id", False), ("shop", "items", "item_id", True), ("shop", "items", "name", False)]
    assert [r["db_id"] for r in CAT.database_ids(spark, d).orderBy("db_ord").collect()] == ["broken", "school", "shop"]
    from sqlforge.operators.retrieval import build_registry
    reg = {r["db_id"]: r for r in build_registry(cat, CAT.database_ids(spark, d)).collect()}
    assert reg["broken"]["keywords"] == ["broken"]
    assert reg["shop"]["keywords"] == ["buyers", "items", "buyer_id", "item_id", "name"]


def test_two_files_never_share_an_id(spark):
    d = _tmp()
    for n in ("a", "b"):
        json.dump([{"db_id": "x", "question": f"q {n}", "query": "SELECT 1"}], open(f"{d}/{n}.json", "w"))
    u = unify_corpora(*[IO.read_qa_json(spark, f"{d}/{n}.json", "s") for n in ("a", "b")])
    assert u.select("sample_id").distinct().count() == 2
    from sqlforge.operators.tokens import token_features
    sft = build_sft(with_clauses(u).withColumn("schema", F.lit("")))
    assert token_features(sft, max_length=64).count() == 2


def test_report_is_read_as_it_was_written(spark):
    d = _tmp()
    det = spark.createDataFrame([(7, "x", "q", "", "", "g", "p\nq", True, False), (9, "x", "q2", "", "", "g", "p", False, False)],
                                "sample_id long, db_id string, question string, evidence string, difficulty string, "
                                "gold_sql string, pred_sql string, ex boolean, em boolean")
    IO.write_eval_report(det, det.groupBy().count(), f"{d}/report")
    for path in (f"{d}/report", f"{d}/report/details"):
        got = IO.read_stage1(spark, path).orderBy("detail_ord").collect()
        assert [(r["detail_ord"], r["pred_sql"], r["ex"]) for r in got] == [(7, "p\nq", True), (9, "p", False)]
    json.dump({"rows": []}, open(f"{d}/other.json", "w"))
    with pytest.raises(ValueError):
        IO.read_stage1(spark, f"{d}/other.json")
    assert IO.read_stage1(spark, f"{d}/none").count() == 0
