"""Clause split, tagged output and parsing: the traps of SURVEY 2.10 with literal expectations."""
from pyspark.sql import functions as F

from sqlforge.functions import clauses as CL
from sqlforge.functions import text as TX


def split(spark, sql):
    return spark.createDataFrame([(sql,)], "q string").select(CL.split_clauses(F.col("q")).alias("c")).first()["c"].asDict()


def test_plain_split(spark):
    c = split(spark, "SELECT name FROM employees WHERE salary > 50000")
    assert c == {"select": "name", "from": "employees", "join": "", "where": "salary > 50000",
                 "group_by": "", "having": "", "order_by": "", "limit": ""}


def test_join_keeps_keyword_and_concatenates(spark):
    c = split(spark, "SELECT e.name FROM employees e JOIN departments d ON e.d = d.id "
                     "left join x ON x.a = d.a WHERE d.name = 'E' ORDER BY e.salary DESC LIMIT 10")
    assert c["join"] == "JOIN departments d ON e.d = d.id LEFT JOIN x ON x.a = d.a"
    assert c["order_by"] == "e.salary DESC" and c["limit"] == "10" and c["from"] == "employees e"


def test_last_keyword_wins_and_offset_stays(spark):  # Q1, Q5
    c = split(spark, "SELECT a FROM t WHERE b IN (SELECT b FROM u WHERE c = 1) LIMIT 3 OFFSET 1")
    assert c["select"] == "b" and c["from"] == "u" and c["where"] == "c = 1)"
    assert c["limit"] == "3 OFFSET 1"


def test_left_outer_join_leaves_left(spark):  # Q2
    c = split(spark, "SELECT a FROM t LEFT OUTER JOIN u ON t.x = u.x")
    assert c["from"] == "t LEFT" and c["join"] == "OUTER JOIN u ON t.x = u.x"


def test_keyword_with_newline_is_lost(spark):  # Q3
    c = split(spark, "select a, count(*) from t group\nby a ;; ")
    assert c["group_by"] == "" and c["from"] == "t" and c["select"] == "a, count(*)"


def test_text_before_first_keyword_dropped(spark):  # Q6
    c = split(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x")
    assert c["select"] == "a" and c["from"] == "x"


def test_three_spaces_lose_clause(spark):  # Q3, one pass of two-space replace
    c = split(spark, "SELECT a FROM t ORDER   BY a")
    assert c["order_by"] == ""


def test_clause_output_format(spark):
    df = spark.createDataFrame([("SELECT a FROM t ;",)], "q string")
    out = df.select(CL.clause_output(CL.split_clauses(F.col("q")), F.col("q")).alias("o")).first()["o"]
    lines = out.split("\n")
    assert lines[0] == "<clause_select> a </clause_select>"
    assert lines[2] == "<clause_join>  </clause_join>"
    assert lines[8:] == ["<summary>", "SELECT a FROM t ;", "</summary>"]


def test_assemble_prefix_without_word_boundary(spark):  # Q7
    df = spark.createDataFrame([("<clause_select> a </clause_select><clause_from>FROM t</clause_from>"
                                 "<clause_order_by> order_date </clause_order_by><clause_group_by>group_id</clause_group_by>",)],
                               "o string")
    r = df.select(CL.assemble_sql(CL.extract_clauses(F.col("o"))).alias("a"),
                  CL.assemble_sql(CL.extract_clauses(F.col("o")), word_boundary=True).alias("b")).first()
    assert r["a"] == "SELECT a\nFROM t\ngroup_id\norder_date"
    assert r["b"] == "SELECT a\nFROM t\nGROUP BY group_id\nORDER BY order_date"


def test_summary_needs_closing_tag(spark):  # Q14
    df = spark.createDataFrame([("<clause_select>x</clause_select><clause_from>t</clause_from><SUMMARY>\nSELECT y",)], "o string")
    r = df.select(CL.extract_summary(F.col("o")).alias("s"), CL.final_sql(F.col("o")).alias("f")).first()
    assert r["s"] == "" and r["f"] == "SELECT x\nFROM t"


def test_reflection_fallbacks(spark):
    rows = [("<reasoning> r </reasoning><answer> SELECT 1 </answer>",), ("x ```SQL\nSELECT 2\n``` y",), ("  SELECT 3  ",),
            ("<ANSWER>SELECT 4</ANSWER>",)]
    df = spark.createDataFrame(rows, "o string").select(CL.extract_reflection(F.col("o")).alias("r"))
    got = [(r["r"]["reasoning"], r["r"]["answer"]) for r in df.collect()]
    assert got == [("r", "SELECT 1"), ("", "SELECT 2"), ("", "SELECT 3"), ("", "<ANSWER>SELECT 4</ANSWER>")]


def test_normalize_sql(spark):
    df = spark.createDataFrame([("  SELECT  COUNT( * )\n FROM T ;; ",)], "q string")
    assert df.select(TX.normalize_sql("q").alias("n")).first()["n"] == "select count(*) from t"


def test_unicode_words(spark):  # Q16
    df = spark.createDataFrame([("Été naïf straße_1 x²",)], "t string")
    assert df.select(TX.words("t").alias("w")).first()["w"] == ["été", "naïf", "straße_1", "x²"]


def test_format_score_counts_exact_case(spark):
    df = spark.createDataFrame([("<clause_select> a </clause_select><SUMMARY>x</SUMMARY>",)], "o string")
    assert abs(df.select(CL.format_score(F.col("o")).alias("s")).first()["s"] - 2 / 18) < 1e-12
