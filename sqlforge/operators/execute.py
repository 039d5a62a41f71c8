"""Running SQL text under guard (E4), dry-run validity (W4), execution feedback.

Model-written SQL is never passed to ``spark.sql`` bare:

1. trailing ``;`` removed, blank text refused;
2. the session's parser must read it as one query (several statements, broken text and commands are
   refused here; parsing executes nothing);
3. its relations must be names of the session: paths (``parquet.`/x` ``) are refused;
4. it is analysed only as ``SELECT * FROM (\\n<text>\\n)``, so DDL and DML inside it are parse
   errors and never execute; an analysis error keeps its whole message;
5. every source in the analysed plan must be a view or table of the session (names may be computed:
   ``IDENTIFIER('parquet.`/x`')``), and it must not call Java by reflection;
6. the job runs in its own job group; a timer that started before step 2 cancels the group at the limit.

A text belongs to a database and runs in that database's session, so two databases may hold tables of one
name. Each distinct (database, text) runs once. Results are appended long-form to one folder per runner
thread below the shared checkpoint folder and read back as one table; nothing is collected. The
driver only iterates over the distinct texts, with a bounded number in hand.
"""

from __future__ import annotations

import hashlib
import re
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CELL_DIGITS, EVAL_TIMEOUT_S, FEEDBACK_ROWS
from ..session import materialize, shared_path
from .ranking import group_row_number

STATUS_SCHEMA = T.StructType([
    T.StructField("sql_id", T.StringType()),
    T.StructField("db_id", T.StringType()),
    T.StructField("sql", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("planned", T.BooleanType()),
])
ROWS_SCHEMA = T.StructType([
    T.StructField("sql_id", T.StringType()),
    T.StructField("rid", T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
    T.StructField("row_str", T.StringType()),
    T.StructField("row_key", T.StringType()),
])
OWN_SOURCES = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef", "EmptyRelation")
REFLECTION = ("CallMethodViaReflection", "TryReflect")
STATUS_BATCH = 500      # finished texts whose statuses are appended at once


def prepare_sql(text: str | None) -> str:
    """Text without surrounding whitespace and without trailing semicolons (any number, spaced or not)."""
    return re.sub(r"[\s;]+$", "", (text or "").strip())


def sql_id_of(text: str | None, db_id: str | None = None) -> str:
    t = prepare_sql(text)
    return hashlib.md5((t if db_id is None else f"{db_id}\n{t}").encode("utf-8")).hexdigest()


def sql_id_col(c, db=None) -> Column:
    """Column form of :func:`sql_id_of` (same md5 of the database and the prepared text)."""
    from ..functions.text import PY_WS, py_strip
    col = F.col(c) if isinstance(c, str) else c
    text = F.regexp_replace(py_strip(F.coalesce(col, F.lit(""))), rf"({PY_WS}|;)+$", "")
    if db is None:
        return F.md5(text)
    db = F.col(db) if isinstance(db, str) else db
    return F.md5(F.when(db.isNull(), text).otherwise(F.concat(db, F.lit("\n"), text)))


def _message(e: Exception) -> str:
    return str(e).strip() or type(e).__name__


def _seq(items):
    it = items.iterator()
    while it.hasNext():
        yield it.next()


def _nodes(plan, below_views: bool = True):
    """Every plan node and expression below a JVM plan, subqueries and CTE definitions included; on demand without what views stand for."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        if not below_views and _kind(node) == "View":
            continue
        todo.extend(_seq(node.children()))
        todo.extend(x for x in _seq(node.innerChildren()) if hasattr(x, "children"))
        for name in ("expressions", "subqueries"):
            try:
                todo.extend(_seq(getattr(node, name)()))
            except Exception:  # an expression has neither
                break
        try:
            todo.append(node.plan())    # a subquery expression
        except Exception:
            pass


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _refusal(spark: SparkSession, parsed) -> str | None:
    """Why a parsed text must not be analysed."""
    for node in _nodes(parsed):
        kind = _kind(node)
        if kind == "UnresolvedRelation":
            parts = list(_seq(node.multipartIdentifier()))
            if len(parts) > 1 and not spark.catalog.databaseExists(parts[0]):
                return f"relation {'.'.join(parts)} is not a table of this database"
        elif kind.endswith("Command") or kind.endswith("Statement"):
            return f"{kind} is not a query"
    return None


def _foreign_source(spark: SparkSession, analysed) -> str | None:
    """Why an analysed plan must not run: a source that is neither a view nor a table of the session.

    Names in a text can be computed (``IDENTIFIER``), so this looks at what they became. Below a view anything may
    stand; elsewhere a plan may only end in literal rows, ranges, references to its own CTEs and catalog tables.
    """
    plan_class = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
    for node in _nodes(analysed, below_views=False):
        kind = _kind(node)
        if kind in ("View", *OWN_SOURCES) or not node.children().isEmpty() or not is_instance_of(spark._sc._gateway, node, plan_class):
            continue
        if kind == "HiveTableRelation" or kind == "LogicalRelation" and node.catalogTable().isDefined():
            continue
        return f"{kind} is not a table of this database"
    return None


def guard(spark: SparkSession, text: str):
    """Return (DataFrame, None) when the text is a single query that plans, else (None, error)."""
    t = prepare_sql(text)
    if not t:
        return None, "empty query"
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(t)
        why = _refusal(spark, parsed)
        if why:
            return None, why
        df = spark.sql("SELECT * FROM (\n" + t + "\n)")
        analysed = df._jdf.queryExecution().analyzed()
        why = _foreign_source(spark, analysed)
        if why:
            return None, why
        for node in _nodes(analysed):
            if _kind(node) in REFLECTION:
                return None, "calls by reflection are not allowed"
    except Exception as e:  # parse errors, DDL/DML inside the wrapper, analysis errors
        return None, _message(e)
    return df, None


def _cell_text(c: Column, dt: T.DataType) -> tuple[Column, Column]:
    """Cell text and its form inside the row text (strings quoted, NULL as None)."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        integral = (c == F.floor(c)) & (F.abs(c) < F.lit(1e16))
        txt = F.when(integral, F.concat(c.cast("long").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))
        return txt, F.coalesce(txt, F.lit("None"))
    if isinstance(dt, T.BooleanType):
        txt = F.initcap(c.cast("string"))
        return txt, F.coalesce(txt, F.lit("None"))
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        return c, F.coalesce(F.concat(F.lit("'"), esc, F.lit("'")), F.lit("None"))
    txt = c.cast("string")
    return txt, F.coalesce(txt, F.lit("None"))


def _cell_key(c: Column, dt: T.DataType, shown: Column) -> Column:
    """Cell text for comparison: equal numbers have one text whatever their type.

    Whole numbers are plain, other numbers have ``CELL_DIGITS`` significant digits (sums may be taken in any
    order), booleans are 1 and 0.
    """
    if isinstance(dt, T.BooleanType):
        return F.coalesce(c.cast("int").cast("string"), F.lit("None"))
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        digits = F.format_string(f"%.{CELL_DIGITS - 1}e", d)
        rounded = digits.cast("double")
        whole = (rounded == F.floor(rounded)) & (F.abs(rounded) < F.lit(1e15))
        txt = F.when(whole, rounded.cast("long").cast("string")).otherwise(digits)
        if isinstance(dt, T.DecimalType):
            # A whole decimal keeps all its digits.
            txt = F.when(c == F.floor(c), F.floor(c).cast("decimal(38,0)").cast("string")).otherwise(txt)
        return F.coalesce(txt, F.lit("None"))
    return shown


def result_rows_of(df: DataFrame) -> DataFrame:
    """Long-form rows of a query result: rid keeps the result order, cells, row text and row key are strings."""
    fields = df.schema.fields
    named = df.toDF(*[f"_c{i}" for i in range(len(fields))])  # duplicate names read by position
    cells = [(F.col(f"_c{i}"), f.dataType) for i, f in enumerate(fields)]
    pairs = [_cell_text(c, dt) for c, dt in cells]
    keys = [_cell_key(c, dt, p[1]) for (c, dt), p in zip(cells, pairs)]
    end = F.lit(",)" if len(pairs) == 1 else ")")

    def row(parts):
        return F.concat(F.lit("("), F.concat_ws(", ", *parts) if parts else F.lit(""), end)

    return named.select(F.monotonically_increasing_id().alias("rid"), F.array(*[p[0] for p in pairs]).alias("cells"),
                        row([p[1] for p in pairs]).alias("row_str"), row(keys).alias("row_key"))


def _run_one(spark: SparkSession, sid: str, db_id: str | None, sql: str, base: str, timeout: float, max_rows: int | None):
    """(sql_id, db_id, sql, status, error, planned) of one text; its rows are appended to this thread's folder."""
    sc = spark.sparkContext
    group = f"sqlforge-{sid}-{uuid.uuid4().hex[:8]}"
    begun, fired = time.monotonic(), threading.Event()

    def cancel():
        fired.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(timeout, cancel)
    timer.daemon = True
    timer.start()
    planned = False
    try:
        sc.setJobGroup(group, "guarded query", interruptOnCancel=True)
        df, err = guard(spark, sql)
        if df is None:
            return (sid, db_id, sql, "error", err, False)
        planned = True
        if fired.is_set() or time.monotonic() - begun > timeout:
            return (sid, db_id, sql, "timeout", f"exceeded {timeout} s", True)
        rows = result_rows_of(df if max_rows is None else df.limit(max_rows))
        rows.select(F.lit(sid).alias("sql_id"), "*").write.mode("append").parquet(f"{base}/rows/{threading.current_thread().name}")
        return (sid, db_id, sql, "ok", "", True)
    except Exception as e:
        if fired.is_set():
            return (sid, db_id, sql, "timeout", f"exceeded {timeout} s", planned)
        return (sid, db_id, sql, "error", _message(e), planned)
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def database_sessions(spark: SparkSession, catalog_root: str) -> Callable[[str | None], SparkSession]:
    """Sessions by database: views of ``<catalog_root>/<db_id>/<table>.parquet``, made at the first use."""
    from ..sources.catalog import tables_of
    made: dict[str, SparkSession] = {}
    lock = threading.Lock()

    def of(db_id: str | None) -> SparkSession:
        if db_id is None:
            return spark
        with lock:
            if db_id not in made:
                own = spark.newSession()
                for name, path in tables_of(spark, f"{catalog_root.rstrip('/')}/{db_id}"):
                    own.read.parquet(path).createOrReplaceTempView(name)
                made[db_id] = own
            return made[db_id]
    return of


def run_sql_batch(spark: SparkSession, sqls: DataFrame, sql_col: str = "sql", timeout: float = EVAL_TIMEOUT_S,
                  out: str | None = None, max_in_flight: int = 4, db_col: str | None = None,
                  session_of: Callable[[str | None], SparkSession] | None = None,
                  max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Run every distinct (database, SQL text) of ``sqls`` under guard.

    ``session_of(db_id)`` gives the session with a database's tables (default: this session for all);
    ``max_rows`` limits the rows taken from each query. Returns ``(status, rows)``: status(sql_id,
    db_id, sql, status, error, planned, n_rows) with status in ok / error / timeout, and rows(sql_id,
    row_no, cells, row_str, row_key) with ``row_no`` the 1-based position in the query's own output order.
    """
    base = out or shared_path(spark, "sql_runs", uuid.uuid4().hex)
    db = F.lit(None).cast("string") if db_col is None else F.col(db_col)
    texts = sqls.select(db.alias("db_id"), F.col(sql_col).alias("sql")).filter(F.col("sql").isNotNull()) \
        .groupBy(sql_id_col("sql", "db_id").alias("sql_id"), "db_id").agg(F.min("sql").alias("sql"))
    session_of = session_of or (lambda _: spark)
    held: list[tuple] = []

    def keep(done, least=STATUS_BATCH):
        held.extend(f.result() for f in done)
        if held and len(held) >= least:
            spark.createDataFrame(held, STATUS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/status")
            held.clear()

    spark.createDataFrame([], STATUS_SCHEMA).write.mode("append").parquet(f"{base}/status")
    spark.createDataFrame([], ROWS_SCHEMA).write.mode("append").parquet(f"{base}/rows/none")
    with ThreadPoolExecutor(max_workers=max_in_flight, thread_name_prefix="run") as pool:
        flying = set()
        for r in texts.toLocalIterator():
            if len(flying) >= 2 * max_in_flight:
                done, flying = wait(flying, return_when=FIRST_COMPLETED)
                keep(done)
            flying.add(pool.submit(lambda r=r: _run_one(session_of(r["db_id"]), r["sql_id"], r["db_id"], r["sql"], base, timeout, max_rows)))
        keep(wait(flying).done, least=1)
    status = spark.read.schema(STATUS_SCHEMA).parquet(f"{base}/status")
    raw = spark.read.schema(ROWS_SCHEMA).parquet(f"{base}/rows/*")
    rows = group_row_number(raw, ["sql_id"], ["rid"], "row_no").select(
        "sql_id", F.col("row_no").cast("int").alias("row_no"), "cells", "row_str", "row_key")
    n = raw.groupBy("sql_id").agg(F.count(F.lit(1)).alias("n_rows"))
    status = status.join(n, "sql_id", "left").withColumn(
        "n_rows", F.when(F.col("status") == "ok", F.coalesce("n_rows", F.lit(0))).otherwise(F.lit(0)))
    return status, rows


def validity_of(sql, planned) -> Column:
    """W4 on columns: 0.0 for blank text, 0.5 when planning was refused, 1.0 when the text planned."""
    sql = F.col(sql) if isinstance(sql, str) else sql
    planned = F.col(planned) if isinstance(planned, str) else planned
    blank = F.regexp_replace(F.coalesce(sql, F.lit("")), r"[\s;]+", "") == ""
    return F.when(blank, F.lit(0.0)).when(F.coalesce(planned, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.5))


def plan_shape(sql) -> Column:
    """The text with those literals alike that can't decide whether it plans.

    These are whole numbers of at most 9 digits and plain strings right behind a comparison sign, and the numbers of LIMIT and OFFSET.
    Everything else stays: names, types, ordinals, arguments, signs, typed literals. A text with other quotes or
    comments is a shape of its own.
    """
    c = F.col(sql) if isinstance(sql, str) else sql
    strings = F.regexp_replace(c, r"([=<>]\s*)'[^'\\]*'(?!')", "$1's'")
    numbers = F.regexp_replace(strings, r"([=<>]\s*)[0-9]{1,9}(?![\p{L}\p{N}_.])", "$10")
    ends = F.regexp_replace(numbers, r"(?i)\b((?:limit|offset)\s+)[0-9]{1,9}(?![\p{L}\p{N}_.])", "$10")
    other = F.replace(strings, F.lit("'s'"), F.lit("")).rlike(r"['\"`\\]|--|/\*")
    return F.when(other, c).otherwise(ends)


def sql_validity(spark: SparkSession, sqls: DataFrame, sql_col: str = "sql",
                 max_in_flight: int = 8) -> DataFrame:
    """W4 as a dry run: (sql_id, validity) per distinct text.

    A dry run on the real tables (the reference's dry run used an empty
    database, where every table reference fails). Runtime errors are not
    found by a dry run. Only the driver can plan a query, so texts are first reduced to their
    shapes (:func:`plan_shape`) and one text of each shape is planned; the state goes back to all texts of
    the shape in a join. Corpora written from templates have a few shapes, however many texts.
    """
    of = sqls.select(F.col(sql_col).alias("sql")).filter(F.col("sql").isNotNull()) \
        .groupBy(sql_id_col("sql").alias("sql_id")).agg(F.min("sql").alias("sql")) \
        .select("sql_id", "sql", F.md5(plan_shape("sql")).alias("shape"))
    of = materialize(of, "sql-shapes")
    states = _dry_run(spark, of.groupBy("shape").agg(F.min("sql").alias("sql")).withColumnRenamed("shape", "sql_id"), max_in_flight)
    return of.select("sql_id", "shape").join(states.withColumnRenamed("sql_id", "shape"), "shape").select("sql_id", "validity")


def _dry_run(spark: SparkSession, texts: DataFrame, max_in_flight: int) -> DataFrame:
    """(sql_id, validity) of the texts (sql_id, sql), a bounded number of them in hand."""
    base = shared_path(spark, "sql_validity", uuid.uuid4().hex)
    held: list[tuple] = []

    def check(r):
        if not prepare_sql(r["sql"]):
            return (r["sql_id"], 0.0)
        return (r["sql_id"], 1.0 if guard(spark, r["sql"])[0] is not None else 0.5)

    def keep(done, least=STATUS_BATCH):
        held.extend(f.result() for f in done)
        if len(held) >= least:
            spark.createDataFrame(held, "sql_id string, validity double").coalesce(1).write.mode("append").parquet(base)
            held.clear()

    with ThreadPoolExecutor(max_workers=max_in_flight) as pool:
        flying = set()
        for r in texts.toLocalIterator():
            if len(flying) >= 2 * max_in_flight:
                done, flying = wait(flying, return_when=FIRST_COMPLETED)
                keep(done)
            flying.add(pool.submit(check, r))
        keep(wait(flying).done, least=0)
    return spark.read.schema("sql_id string, validity double").parquet(base)


def exec_feedback(rows: DataFrame, status: DataFrame, key: str = "sql_id",
                  n_rows: int = FEEDBACK_ROWS) -> DataFrame:
    """Text of the first ``n_rows`` result rows as a Python-style list, or the error text.

    Only rows with ``row_no <= n_rows`` are gathered, so each group holds at most ``n_rows`` rows.
    """
    head = (rows.filter(F.col("row_no") <= n_rows)
            .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row_no", "row_str"))).alias("h")))
    j = status.join(head, key, "left")
    ok = F.col("status") == "ok"
    text = F.when(F.col("h").isNull(), F.lit("[]")).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform("h", lambda x: x["row_str"]), ", "), F.lit("]")))
    return j.select(key, F.when(ok, text).otherwise(F.lit("")).alias("exec_result"),
                    F.when(ok, F.lit("")).otherwise(F.coalesce("error", F.lit("error"))).alias("exec_error"))
