"""Guarded execution: refusals, ordering, time limit, feedback."""
import time

from pyspark.sql import functions as F

from sqlforge.operators import evaluate as EV
from sqlforge.operators import execute as EX
from sqlforge.operators import rewards as RW
from sqlforge.session import register_tables

from conftest import SF_SMALL


def _run(spark, texts, timeout=30.0):
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    return EX.run_sql_batch(spark, df, timeout=timeout)


def test_refusals_and_statuses(spark):
    register_tables(spark, SF_SMALL, ("customer", "orders"))
    texts = ["SELECT 1; SELECT 2", "SELEC c_name FROM customer", "SELECT c_nme FROM customer",
             "DROP TABLE customer", "WITH x AS (SELECT 1 AS a) INSERT INTO customer SELECT * FROM customer",
             "SELECT CAST(c_name AS INT) AS bad FROM customer", "   ", "SELECT c_custkey FROM customer ;; ;"]
    status, rows = _run(spark, texts)
    st = {r["sql"]: (r["status"], r["n_rows"]) for r in status.collect()}
    for t in texts[:6]:
        assert st[t][0] == "error", t
    assert st["   "][0] == "error"
    assert st["SELECT c_custkey FROM customer ;; ;"] == ("ok", 150)
    # the DROP never ran
    assert spark.sql("SELECT count(*) AS n FROM customer").first()["n"] == 150


def test_order_is_kept_and_rows_numbered(spark):
    register_tables(spark, SF_SMALL, ("orders",))
    q = "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey"
    status, rows = _run(spark, [q])
    got = [r["cells"][0] for r in rows.orderBy("row_no").collect()]
    want = [str(r[0]) for r in spark.sql(q).collect()]
    assert got == want
    assert [r["row_no"] for r in rows.orderBy("row_no").collect()] == list(range(1, len(want) + 1))
    r0 = rows.filter(F.col("row_no") == 1).first()
    assert r0["row_str"] == f"({want[0]}, '{spark.sql(q).first()[1]}')"


def test_time_limit(spark):
    register_tables(spark, SF_SMALL, ("lineitem",))
    slow = ("SELECT count(*) FROM lineitem a JOIN lineitem b ON a.l_suppkey <> b.l_suppkey "
            "JOIN lineitem c ON b.l_partkey <> c.l_partkey")
    t0 = time.time()
    status, _ = _run(spark, [slow], timeout=2.0)
    assert status.first()["status"] == "timeout"
    assert time.time() - t0 < 60


def test_messages_are_whole(spark):
    register_tables(spark, SF_SMALL, ("customer",))
    status, _ = _run(spark, ["SELECT c_nme FROM customer", "SELECT x FROM nosuch", "SELECT 1 +"])
    err = {r["sql"]: r["error"] for r in status.collect()}
    assert "c_nme" in err["SELECT c_nme FROM customer"] and "c_name" in err["SELECT c_nme FROM customer"]   # names what exists
    assert "nosuch" in err["SELECT x FROM nosuch"] and "\n" in err["SELECT 1 +"]
    assert not any(r["planned"] for r in status.collect())


def test_unsafe_texts_are_refused(spark):
    register_tables(spark, SF_SMALL, ("customer",))
    path = f"{SF_SMALL}/customer.parquet"
    bad = ["SELECT reflect('java.lang.Integer', 'toString', 7)", "SELECT java_method('java.lang.Integer', 'toString', 7)",
           "SELECT try_reflect('java.lang.Integer', 'toString', 7)", f"SELECT * FROM parquet.`{path}`",
           f"SELECT (SELECT count(*) FROM parquet.`{path}`) AS n", f"WITH t AS (SELECT * FROM parquet.`{path}`) SELECT * FROM t",
           "SELECT c_custkey FROM customer WHERE c_name = (SELECT max(reflect('java.lang.Integer', 'toString', c_custkey)) FROM customer)",
           f"SELECT * FROM IDENTIFIER('parquet.`{path}`')", f"SELECT (SELECT count(*) FROM IDENTIFIER('parquet.`{path}`')) AS n",
           f"WITH t AS (SELECT * FROM IDENTIFIER('parquet.`{path}`')) SELECT * FROM t", f"SELECT * FROM IDENTIFIER(concat('parquet', '.`{path}`'))",
           f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM IDENTIFIER('csv.`{path}`'))",
           "SELECT 1) UNION ALL (SELECT 2", "SET spark.sql.shuffle.partitions=1", "SHOW TABLES", "CACHE TABLE customer"]
    good = ["SELECT 'reflect(1)' AS t, 'parquet.`/x`' AS p", "WITH t AS (SELECT c_custkey FROM customer) SELECT count(*) FROM t",
            "VALUES (1), (2)", "SELECT id FROM range(3)", "SELECT count(*) FROM IDENTIFIER('customer')",
            "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT * FROM t", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT max(c_custkey) FROM customer)"]
    status, _ = _run(spark, bad + good)
    got = {r["sql"]: r["status"] for r in status.collect()}
    assert {t: got[t] for t in bad} == {t: "error" for t in bad}
    assert {t: got[t] for t in good} == {t: "ok" for t in good}


def test_numbers_compare_by_value(spark):
    register_tables(spark, SF_SMALL, ("orders",))
    pairs = [(1, "SELECT CAST(count(*) AS DOUBLE) FROM orders", "SELECT count(*) FROM orders", True),
             (2, "SELECT sum(o_totalprice) * 1.0 FROM orders", "SELECT sum(o_totalprice) FROM orders", True),
             (3, "SELECT CAST(7.5 AS DECIMAL(9,3))", "SELECT 7.5D", True), (4, "SELECT 0.1D + 0.2D", "SELECT 0.3D", True),
             (5, "SELECT true", "SELECT 1", True), (6, "SELECT '1'", "SELECT 1", False), (7, "SELECT -0.0D", "SELECT 0", True),
             (8, "SELECT 1.5", "SELECT 1.25", False), (9, "SELECT CAST(NULL AS INT)", "SELECT CAST(NULL AS STRING)", True),
             (10, "SELECT CAST(12345678901234567890 AS DECIMAL(20,0))", "SELECT CAST(12345678901234567891 AS DECIMAL(20,0))", False)]
    df = spark.createDataFrame([p[:3] for p in pairs], "sample_id long, pred_sql string, gold_sql string")
    status, rows = EX.run_sql_batch(spark, df.select(F.explode(F.array("pred_sql", "gold_sql")).alias("sql")))
    rw, st = EV.pair_results(df, status, rows)
    assert {r["sample_id"]: r["ex"] for r in EV.execution_match(rw, st).collect()} == {p[0]: p[3] for p in pairs}
    assert {r["sample_id"]: r["r_exec"] == 1.0 for r in RW.reward_execution(rw, st).collect()} == {p[0]: p[3] for p in pairs} | {6: True}


def test_each_database_has_its_own_tables(spark, tmp_path):
    for db, n in (("a", 3), ("b", 5)):
        spark.range(n).withColumnRenamed("id", "k").write.parquet(str(tmp_path / db / "student.parquet"))
    df = spark.createDataFrame([("a", "SELECT count(*) FROM student"), ("b", "SELECT count(*) FROM student;"), ("b", "SELECT 9")],
                               "db_id string, sql string")
    status, rows = EX.run_sql_batch(spark, df, db_col="db_id", session_of=EX.database_sessions(spark, str(tmp_path)))
    got = {(r["db_id"], r["cells"][0]) for r in rows.join(status, "sql_id").collect()}
    assert got == {("a", "3"), ("b", "5"), ("b", "9")}
    assert not spark.catalog.tableExists("student")


def test_rows_taken_are_limited(spark):
    status, rows = EX.run_sql_batch(spark, spark.createDataFrame([("SELECT id FROM range(100000) ORDER BY id DESC",)], "sql string"), max_rows=10)
    assert [r["cells"][0] for r in rows.orderBy("row_no").collect()] == [str(99999 - k) for k in range(10)]
    assert status.first()["n_rows"] == 10


def test_many_texts(spark):
    n = EX.STATUS_BATCH // 10 + 30
    status, rows = _run(spark, [f"SELECT {k} AS k" for k in range(n)])
    assert status.filter("status = 'ok'").count() == n and rows.count() == n


def test_validity_and_feedback(spark):
    register_tables(spark, SF_SMALL, ("customer",))
    df = spark.createDataFrame([("",), ("SELECT c_nme FROM customer",), ("SELECT c_custkey FROM customer",)], "sql string")
    v = {r["sql_id"]: r["validity"] for r in EX.sql_validity(spark, df).collect()}
    assert v[EX.sql_id_of("")] == 0.0
    assert v[EX.sql_id_of("SELECT c_nme FROM customer")] == 0.5
    assert v[EX.sql_id_of("SELECT c_custkey FROM customer")] == 1.0
    status, rows = _run(spark, ["SELECT c_custkey FROM customer ORDER BY c_custkey", "SELECT c_nme FROM customer"])
    fb = {r["sql_id"]: r for r in EX.exec_feedback(rows, status).collect()}
    ok = fb[EX.sql_id_of("SELECT c_custkey FROM customer ORDER BY c_custkey")]
    assert ok["exec_result"] == "[" + ", ".join(f"({i},)" for i in range(10)) + "]" and ok["exec_error"] == ""
    bad = fb[EX.sql_id_of("SELECT c_nme FROM customer")]
    assert bad["exec_result"] == "" and bad["exec_error"] != ""


def test_shapes_keep_what_can_decide_planning(spark):
    alike = [("SELECT a FROM t WHERE b = 12 AND c <> 'x' LIMIT 5", "SELECT a FROM t WHERE b = 7 AND c <> 'yy' LIMIT 90"), ("SELECT 1 WHERE a >=3", "SELECT 1 WHERE a >=44")]
    apart = [("SELECT a FROM t ORDER BY 1", "SELECT a FROM t ORDER BY 9"), ("SELECT 1 WHERE a = 1", "SELECT 1 WHERE a = 1.5"), ("SELECT DATE '2020-01-01'", "SELECT DATE 'x'"),
             ("SELECT CAST(a AS DECIMAL(9,2))", "SELECT CAST(a AS DECIMAL(99,2))"), ("SELECT 1 WHERE a = 1", "SELECT 1 WHERE a = 12345678901"),
             ("SELECT 1 LIMIT 1", "SELECT 1 LIMIT -1"), ("SELECT ntile(0) OVER (ORDER BY a) FROM t", "SELECT ntile(2) OVER (ORDER BY a) FROM t"),
             ("SELECT 1 WHERE a = 'it''s 1'", "SELECT 1 WHERE a = 'it''s 2'"), ("SELECT 1 WHERE a = 2x", "SELECT 1 WHERE a = 3x")]
    df = spark.createDataFrame([(k, i, t) for k, p in enumerate(alike + apart) for i, t in enumerate(p)], "k int, i int, t string")
    shapes = {(r.k, r.i): r.s for r in df.select("k", "i", EX.plan_shape("t").alias("s")).collect()}
    for k in range(len(alike + apart)):
        assert (shapes[k, 0] == shapes[k, 1]) == (k < len(alike)), (alike + apart)[k]


def test_validity_by_shape_equals_planning_every_text(spark):
    register_tables(spark, SF_SMALL, ("customer", "orders"))
    texts = [f"SELECT c_name FROM customer WHERE c_custkey = {k}" for k in range(30)] + [f"SELECT c_nothing FROM customer WHERE c_custkey = {k}" for k in range(30)] + [
        "", " ; ", "SELECT c_name FROM customer ORDER BY 1", "SELECT c_name FROM customer ORDER BY 5", "DROP TABLE customer", "SELECT 1 WHERE 1 = DATE 'x'"]
    got = {r.sql_id: r.validity for r in EX.sql_validity(spark, spark.createDataFrame([(t,) for t in texts], "sql string")).collect()}
    want = {EX.sql_id_of(t): 0.0 if not EX.prepare_sql(t) else 1.0 if EX.guard(spark, t)[0] is not None else 0.5 for t in texts}
    assert got == want
