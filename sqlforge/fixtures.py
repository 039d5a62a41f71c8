"""Derived fixtures F1-F10.

The driver tables hold no text-to-SQL corpus, so each fixture is derived from
them by one SQL text that Spark SQL and DuckDB both run unchanged (integers
and strings only, ``key % n`` instead of random draws). Spark runs it over
temporary views of the Parquet tables; the DuckDB oracles embed the same text
as a CTE. Every fixture grows with the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import register_tables

NL = "chr(10)"
Q = "chr(39)"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


# ---------------------------------------------------------------- F1 corpus
# Eight SQL shapes by c_custkey % 8; parts are kept for the F2 outputs.
_F1_PARTS = f"""
SELECT c_custkey AS k, c_custkey % 8 AS tpl, c_nationkey AS nk, c_mktsegment AS seg,
  CASE c_custkey % 8
    WHEN 0 THEN 'SELECT c_name, c_acctbal FROM customer WHERE c_custkey = ' || {_s('c_custkey')}
    WHEN 1 THEN 'SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ' || {_s('c_custkey')}
                || ' ORDER BY o_totalprice DESC LIMIT ' || {_s('c_custkey % 5 + 1')}
    WHEN 2 THEN 'SELECT c.c_name, n.n_name FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey = '
                || {_s('c_custkey')}
    WHEN 3 THEN 'SELECT o_orderstatus, COUNT(*) AS n_orders FROM orders WHERE o_custkey <= ' || {_s('c_custkey')}
                || ' GROUP BY o_orderstatus HAVING COUNT(*) > ' || {_s('c_custkey % 7')} || ' ORDER BY n_orders DESC'
    WHEN 4 THEN 'SELECT DISTINCT c.c_mktsegment, n.n_name FROM customer AS c LEFT JOIN nation AS n ON c.c_nationkey = n.n_nationkey'
                || ' INNER JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey = ' || {_s('c_custkey % 5')}
    WHEN 5 THEN 'SELECT c.c_name, o.o_orderkey FROM customer AS c LEFT OUTER JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = '
                || {Q} || c_mktsegment || {Q} || ' AND c.c_nationkey = ' || {_s('c_nationkey')}
    WHEN 6 THEN 'SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = '
                || {_s('c_nationkey')} || ') LIMIT 3 OFFSET 1'
    ELSE '   select c_mktsegment, count(*) AS orders_total from customer where c_nationkey = ' || {_s('c_nationkey')}
                || ' group' || {NL} || 'by c_mktsegment order by orders_total desc ;; '
  END AS query,
  CASE c_custkey % 8
    WHEN 0 THEN 'c_name, c_acctbal' WHEN 1 THEN 'o_orderkey, o_totalprice' WHEN 2 THEN 'c.c_name, n.n_name'
    WHEN 3 THEN 'o_orderstatus, COUNT(*) AS n_orders' WHEN 4 THEN 'DISTINCT c.c_mktsegment, n.n_name'
    WHEN 5 THEN 'SELECT c.c_name, o.o_orderkey' WHEN 6 THEN 'o_orderkey'
    ELSE 'c_mktsegment, count(*) AS orders_total' END AS p_select,
  CASE c_custkey % 8
    WHEN 1 THEN 'orders' WHEN 3 THEN 'FROM orders' WHEN 6 THEN 'orders' WHEN 0 THEN 'customer' WHEN 7 THEN 'customer'
    ELSE 'customer AS c' END AS p_from,
  CASE c_custkey % 8
    WHEN 2 THEN 'JOIN nation AS n ON c.c_nationkey = n.n_nationkey'
    WHEN 4 THEN 'LEFT JOIN nation AS n ON c.c_nationkey = n.n_nationkey INNER JOIN region AS r ON n.n_regionkey = r.r_regionkey'
    WHEN 5 THEN 'LEFT OUTER JOIN orders AS o ON c.c_custkey = o.o_custkey'
    ELSE '' END AS p_join,
  CASE c_custkey % 8
    WHEN 0 THEN 'c_custkey = ' || {_s('c_custkey')} WHEN 1 THEN 'o_custkey = ' || {_s('c_custkey')}
    WHEN 2 THEN 'c.c_custkey = ' || {_s('c_custkey')} WHEN 3 THEN 'WHERE o_custkey <= ' || {_s('c_custkey')}
    WHEN 4 THEN 'r.r_regionkey = ' || {_s('c_custkey % 5')}
    WHEN 5 THEN 'c.c_mktsegment = ' || {Q} || c_mktsegment || {Q} || ' AND c.c_nationkey = ' || {_s('c_nationkey')}
    WHEN 6 THEN 'o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = ' || {_s('c_nationkey')} || ')'
    ELSE 'c_nationkey = ' || {_s('c_nationkey')} END AS p_where,
  CASE c_custkey % 8 WHEN 3 THEN 'o_orderstatus' WHEN 7 THEN 'c_mktsegment' ELSE '' END AS p_group_by,
  CASE c_custkey % 8 WHEN 3 THEN 'COUNT(*) > ' || {_s('c_custkey % 7')} ELSE '' END AS p_having,
  CASE c_custkey % 8 WHEN 1 THEN 'o_totalprice DESC' WHEN 3 THEN 'ORDER BY n_orders DESC'
    WHEN 7 THEN 'orders_total DESC' ELSE '' END AS p_order_by,
  CASE c_custkey % 8 WHEN 1 THEN {_s('c_custkey % 5 + 1')} WHEN 6 THEN '3 OFFSET 1' ELSE '' END AS p_limit,
  CASE WHEN c_custkey % 97 = 0 THEN ''
    ELSE CASE c_custkey % 8
      WHEN 0 THEN 'What is the name and account balance of customer ' || {_s('c_custkey')} || '?'
      WHEN 1 THEN 'List the ' || {_s('c_custkey % 5 + 1')} || ' most expensive orders of customer ' || {_s('c_custkey')} || '.'
      WHEN 2 THEN 'Which nation does customer ' || {_s('c_custkey')} || ' belong to?'
      WHEN 3 THEN 'How many orders per status do customers up to ' || {_s('c_custkey')} || ' have, for statuses with more than '
                  || {_s('c_custkey % 7')} || ' orders?'
      WHEN 4 THEN 'Which market segments and nations appear in region ' || {_s('c_custkey % 5')} || '?'
      WHEN 5 THEN 'Show the orders of ' || lower(c_mktsegment) || ' customers from nation ' || {_s('c_nationkey')} || '.'
      WHEN 6 THEN 'Give the second to fourth orders of customers in nation ' || {_s('c_nationkey')} || '.'
      ELSE 'Count the customers of nation ' || {_s('c_nationkey')} || ' per market segment, most first.' END
  END AS question
FROM customer
"""

F1_QA_CORPUS = f"""
SELECT CAST(k AS BIGINT) AS sample_id,
  CASE WHEN k % 3 = 0 THEN 'kb' ELSE 'plain' END AS source,
  CASE WHEN k % 10 >= 8 THEN 'dev' ELSE 'train' END AS split,
  'sales' AS db_id, question, query,
  CASE WHEN k % 3 = 0 THEN 'segment means c_mktsegment; nation ' || {_s('nk')} || ' is NATION_' || {_s('nk')} ELSE '' END AS evidence,
  CASE WHEN k % 3 = 0 THEN CASE k % 9 WHEN 0 THEN 'simple' WHEN 3 THEN 'moderate' ELSE 'challenging' END ELSE '' END AS difficulty
FROM ({_F1_PARTS}) p
"""


def _tag_lines(upper: bool, skip: tuple[str, ...] = ()) -> str:
    names = ["select", "from", "join", "where", "group_by", "having", "order_by", "limit"]
    pieces = []
    for name in names:
        if name in skip:
            continue
        tag = f"clause_{name}".upper() if upper else f"clause_{name}"
        pieces.append(f"'<{tag}> ' || p_{name} || ' </{tag}>'")
    return f" || {NL} || ".join(pieces)


# ---------------------------------------------------------------- F2 outputs
F2_MODEL_OUTPUTS = f"""
SELECT CAST(k AS BIGINT) AS sample_id,
  CASE k % 5
    WHEN 0 THEN {_tag_lines(False)} || {NL} || '<summary>' || {NL} || trim(query) || {NL} || '</summary>'
    WHEN 1 THEN {_tag_lines(False)}
    WHEN 2 THEN {_tag_lines(False)} || {NL} || '<summary>' || {NL} || trim(query)
    WHEN 3 THEN {_tag_lines(True, skip=("having", "limit"))}
    ELSE CASE k % 20
      WHEN 4 THEN '<reasoning>' || {NL} || 'The filter used the wrong key.' || {NL} || '</reasoning>' || {NL}
                  || '<answer>' || {NL} || trim(query) || {NL} || '</answer>'
      WHEN 14 THEN '<reasoning>needs a join</reasoning><answer>  </answer>' || {NL} || 'Fixed:' || {NL}
                  || '```SQL' || {NL} || trim(query) || {NL} || '```'
      WHEN 9 THEN 'Fixed query:' || {NL} || '```sql' || {NL} || trim(query) || {NL} || '```' || {NL}
      ELSE {NL} || '  ' || trim(query) || '  ' || {NL} END
  END AS output
FROM ({_F1_PARTS}) p
"""

# ---------------------------------------------------------------- F3 pairs
F3_PAIRS = f"""
SELECT CAST(k AS BIGINT) AS sample_id,
  CASE k % 5
    WHEN 0 THEN query
    WHEN 1 THEN upper(replace(query, ' ', '  ')) || ' ;'
    WHEN 2 THEN replace(replace(query, ' = ', ' <> '), 'DESC', 'ASC')
    WHEN 3 THEN replace(replace(query, 'c_name', 'c_phone'), 'o_orderkey', 'o_orderdate')
    ELSE '' END AS pred_sql,
  query AS gold_sql
FROM ({_F1_PARTS}) p
"""

# ---------------------------------------------------------------- F4 results
_F4_GOLD_SQL = "'SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = ' || " + _s("c_custkey")
_F4_BASE = """
SELECT o_custkey AS sample_id, o_orderkey, o_orderstatus, o_orderpriority,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rrn,
  count(*) OVER (PARTITION BY o_custkey) AS n
FROM orders
"""

F4_RESULT_ROWS = f"""
SELECT CAST(sample_id AS BIGINT) AS sample_id, side, CAST(row_no AS INT) AS row_no,
  split({_s('o_orderkey')} || ';' || o_orderstatus || ';' || o_orderpriority, ';') AS cells,
  '(' || {_s('o_orderkey')} || ', ' || {Q} || o_orderstatus || {Q} || ', ' || {Q} || o_orderpriority || {Q} || ')' AS row_str
FROM (
  SELECT sample_id, 'gold' AS side, rn AS row_no, o_orderkey, o_orderstatus, o_orderpriority
  FROM ({_F4_BASE}) g WHERE sample_id % 97 <> 0
  UNION ALL
  SELECT sample_id, 'pred' AS side,
    CASE WHEN sample_id % 8 IN (1, 7) THEN rrn ELSE rn END AS row_no, o_orderkey,
    CASE WHEN sample_id % 8 = 3 AND rn = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority
  FROM ({_F4_BASE}) g WHERE sample_id % 8 IN (0, 1, 3, 4, 7) OR (sample_id % 8 = 2 AND rn > 1)
  UNION ALL
  SELECT sample_id, 'pred' AS side, n + 1 AS row_no, o_orderkey, o_orderstatus, o_orderpriority
  FROM ({_F4_BASE}) g WHERE sample_id % 8 = 4 AND rn = 1
) r
"""

F4_RESULT_STATUS = f"""
SELECT CAST(c_custkey AS BIGINT) AS sample_id, 'gold' AS side, 'ok' AS status, {_F4_GOLD_SQL} AS sql
FROM customer
UNION ALL
SELECT CAST(c_custkey AS BIGINT) AS sample_id, 'pred' AS side,
  CASE WHEN c_custkey % 8 = 6 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 8 = 7 THEN {_F4_GOLD_SQL} || ' ORDER BY o_orderkey DESC' ELSE {_F4_GOLD_SQL} END AS sql
FROM customer
"""

F4_RESULT_STATUS_ERR = f"""
SELECT sample_id, side, status, sql,
  CASE WHEN status = 'error' THEN 'unknown column o_x in query ' || {_s('sample_id')} ELSE '' END AS error
FROM ({F4_RESULT_STATUS}) s
"""

# ---------------------------------------------------------------- F6 questions
F6_QUESTIONS = f"""
SELECT CAST(c_custkey AS BIGINT) AS q_id,
  CASE c_custkey % 12
    WHEN 0 THEN 'show customer names and account balance acctbal for nation ' || {_s('c_nationkey')}
    WHEN 1 THEN 'total price of orders with order status F and order priority'
    WHEN 2 THEN 'which supplier has the highest acctbal in nation ' || {_s('c_nationkey')}
    WHEN 3 THEN 'list part brand and type with size above ' || {_s('c_custkey % 50')}
    WHEN 4 THEN 'lineitem quantity discount and tax for order ' || {_s('c_custkey')}
    WHEN 5 THEN 'region name of each nation'
    WHEN 6 THEN 'count events by event type for user ' || {_s('c_custkey')}
    WHEN 7 THEN 'average value of events per user and event type'
    WHEN 8 THEN 'documents text in language de with source and n_chars'
    WHEN 9 THEN 'conversation turn role and text of conversation ' || {_s('c_custkey')}
    WHEN 10 THEN 'pages url and html of page ' || {_s('c_custkey')}
    ELSE 'labels quality and toxic per document doc_id' END AS question,
  CASE WHEN c_custkey % 5 = 0 THEN
    CASE WHEN c_custkey % 12 IN (6, 7) THEN 'clickstream' WHEN c_custkey % 12 >= 8 THEN 'corpus' ELSE 'sales' END
  END AS db_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'acctbal is the account balance' ELSE '' END AS evidence
FROM customer
UNION ALL
SELECT CAST(-(conv_id * 100 + turn) - 1 AS BIGINT) AS q_id, text AS question,
  CAST(NULL AS STRING) AS db_id, '' AS evidence
FROM conversations WHERE role = 'user'
"""

# Every question with a database: its own, else one by its number.
F6_QUESTIONS_PLACED = f"""
SELECT q_id, question, evidence,
  coalesce(db_id, CASE abs(q_id) % 3 WHEN 0 THEN 'sales' WHEN 1 THEN 'clickstream' ELSE 'corpus' END) AS db_id
FROM ({F6_QUESTIONS}) q
"""

# ---------------------------------------------------------------- F7 history
F7_HISTORY = """
SELECT CAST(conv_id * 100 + turn AS BIGINT) AS hist_ord,
  CASE conv_id % 3 WHEN 0 THEN 'sales' WHEN 1 THEN 'clickstream' ELSE 'corpus' END AS db_id,
  text AS question, next_text AS sql
FROM (
  SELECT conv_id, turn, role, text,
    lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
  FROM conversations
) c
WHERE role = 'user' AND next_text IS NOT NULL
"""

# ---------------------------------------------------------------- F8 vectors
F8_VEC_QUERIES = "SELECT vec_id, embedding, label FROM embeddings"
F8_VEC_HISTORY = "SELECT vec_id, embedding, label FROM embeddings"

# ---------------------------------------------------------------- F9 rollouts
F9_ROLLOUTS = """
SELECT CAST(l_orderkey AS BIGINT) AS group_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey
       ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS output_idx,
  l_discount * 10 AS reward,
  -l_quantity / 10 AS logp_new,
  -(l_quantity + l_tax * 10) / 10 AS logp_ref
FROM lineitem
"""

# Two runs of three epochs; each group id recurs in all six.
F9_ROLLOUT_RUNS = """
SELECT CAST(floor(l_orderkey / 6) AS BIGINT) AS group_id, CAST(l_orderkey % 3 AS INT) AS epoch,
  CAST(floor(l_orderkey / 3) % 2 AS INT) AS run_id,
  l_discount * 10 AS reward, -l_quantity / 10 AS logp_new, -(l_quantity + l_tax * 10) / 10 AS logp_ref
FROM lineitem
"""

# ---------------------------------------------------------------- F10 eval rows
F10_EVAL_ROWS = """
SELECT CAST(o_orderkey AS BIGINT) AS sample_id,
  CASE o_orderpriority WHEN '5-LOW' THEN CAST(NULL AS STRING) WHEN '4-NOT SPECIFIED' THEN ''
    ELSE o_orderpriority END AS difficulty,
  o_orderkey % 3 <> 0 AS ex,
  o_orderkey % 7 = 0 AS em
FROM orders
"""

FIXTURES = {
    "qa_corpus": (F1_QA_CORPUS, ("customer",)),
    "model_outputs": (F2_MODEL_OUTPUTS, ("customer",)),
    "pairs": (F3_PAIRS, ("customer",)),
    "result_rows": (F4_RESULT_ROWS, ("orders",)),
    "result_status": (F4_RESULT_STATUS, ("customer",)),
    "result_status_err": (F4_RESULT_STATUS_ERR, ("customer",)),
    "sql_pairs": (None, ("customer", "orders")),
    "questions": (F6_QUESTIONS, ("customer", "conversations")),
    "questions_placed": (F6_QUESTIONS_PLACED, ("customer", "conversations")),
    "rollout_runs": (F9_ROLLOUT_RUNS, ("lineitem",)),
    "history": (F7_HISTORY, ("conversations",)),
    "vec_queries": (F8_VEC_QUERIES, ("embeddings",)),
    "vec_history": (F8_VEC_HISTORY, ("embeddings",)),
    "rollouts": (F9_ROLLOUTS, ("lineitem",)),
    "eval_rows": (F10_EVAL_ROWS, ("orders",)),
}

DEALT = ("customer",)      # tables whose short rows become long texts


# ---------------------------------------------------------------- fixed SQL pairs
# Twelve pred/gold pairs over customer and orders: equal; equal up to row order;
# ordered and equal; ordered and different; different columns; empty result;
# several statements; syntax error; unknown column; DROP; WITH ... INSERT;
# runtime cast error. The texts are fixed, the data they read is whole tables.
_G = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 1"
SQL_PAIRS = [
    (1, "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment"),
    (2, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 = 0",
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 = 0 AND o_totalprice >= 0;"),
    (3, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey DESC",
        "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey DESC"),
    (4, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 4 ORDER BY c_custkey",
        "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 4 ORDER BY c_custkey DESC"),
    (5, "SELECT c_custkey FROM customer", "SELECT c_name FROM customer"),
    (6, "SELECT c_custkey FROM customer WHERE c_custkey < 0", "SELECT c_custkey FROM customer WHERE c_custkey < 0"),
    (7, "SELECT 1; SELECT 2", _G),
    (8, "SELEC c_name FROM customer", _G),
    (9, "SELECT c_nme FROM customer", _G),
    (10, "DROP TABLE customer", _G),
    (11, "WITH x AS (SELECT 1 AS a) INSERT INTO customer SELECT * FROM customer", _G),
    (12, "SELECT CAST(c_name AS INT) AS bad FROM customer", _G),
]


def sql_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed pairs as a table (sample_id, pred_sql, gold_sql); tables registered for running them."""
    register_tables(spark, sf_dir, ("customer", "orders"))
    return spark.createDataFrame(SQL_PAIRS, "sample_id long, pred_sql string, gold_sql string")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build fixture ``name`` with Spark SQL over the driver tables of ``sf_dir``."""
    if name == "sql_pairs":
        return sql_pairs(spark, sf_dir)
    sql, tables = FIXTURES[name]
    register_tables(spark, sf_dir, tables, DEALT)
    df = spark.sql(sql)
    register_tables(spark, sf_dir, [t for t in tables if t in DEALT])      # the views that others read are the plain tables
    return df


def cte(*names: str) -> str:
    """``WITH`` prefix that defines the named fixtures for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n][0]})" for n in names) + "\n"
