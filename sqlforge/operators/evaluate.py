"""Evaluation E2-E8: exact match, execution match over long-form results, reports.

Results are long-form tables (one row per result row):
``rows(sample_id, side, row_no, cells, row_str[, row_key])`` and
``status(sample_id, side, status, sql)`` with side in {'pred', 'gold'}.
Rows are compared by ``row_key`` (equal numbers of any type have one text), by ``row_str`` where a table has
none. Nothing is collected per sample: comparisons are joins and aggregates keyed
by (sample, row), so a sample with a huge result is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_order_by, normalize_sql
from ..session import materialize
from .ranking import group_row_number


def exact_match(df: DataFrame, pred: str = "pred_sql", gold: str = "gold_sql") -> DataFrame:
    """Normalised pred equals normalised gold."""
    return df.withColumn("em", normalize_sql(pred) == normalize_sql(gold))


def rate(df: DataFrame, flag: str, name: str) -> DataFrame:
    """Share of true flags, 0.0 on no rows."""
    return df.agg(F.coalesce(F.round(F.avg(F.col(flag).cast("double")), 9), F.lit(0.0)).alias(name),
                  F.count(F.lit(1)).alias("n"))


def _sides(status: DataFrame) -> DataFrame:
    """One row per sample: both statuses and order flags of both SQL texts."""
    s = status.select("sample_id", "side", "status", has_order_by(F.coalesce("sql", F.lit(""))).alias("ordered"))
    return s.groupBy("sample_id").agg(
        F.max(F.when(F.col("side") == "pred", F.col("status") == "ok")).alias("pred_ok"),
        F.max(F.when(F.col("side") == "gold", F.col("status") == "ok")).alias("gold_ok"),
        F.max(F.when(F.col("side") == "pred", F.col("ordered"))).alias("pred_ordered"),
        F.max(F.when(F.col("side") == "gold", F.col("ordered"))).alias("gold_ordered"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    return rows if "row_key" in rows.columns else rows.withColumn("row_key", F.col("row_str"))


def _equal_lists(rows: DataFrame, position: Column | None) -> DataFrame:
    """Per sample: True when both sides hold the same rows (at the same positions, if given) equally often."""
    keys = ["row_key"] if position is None else [position.alias("pos"), "row_key"]
    diff = rows.groupBy("sample_id", *keys).agg(F.sum(F.when(F.col("side") == "pred", 1).otherwise(-1)).alias("d"))
    return diff.groupBy("sample_id").agg(F.bool_and(F.col("d") == 0).alias("same"))


def _same_order_match(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Match per sample where one flag holds for both sides: kept order compares position by position,
    otherwise the rows are a multiset. One join and two aggregates with map-side combine, no numbering."""
    r = _keyed(rows).join(flags, "sample_id")
    return _equal_lists(r, F.when(F.col("ordered"), F.col("row_no").cast("long")))


def _mixed_match(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Match per sample where one side keeps its order and the other is sorted by row text.

    Positions of sorted sides come from a distributed in-group numbering (no per-sample window).
    """
    r = _keyed(rows).join(flags, "sample_id") \
        .withColumn("ordered", F.when(F.col("side") == "pred", F.col("po")).otherwise(F.col("go")))
    numbered = group_row_number(r, ["sample_id", "side"], ["row_str", "row_no"], "sorted_no")
    return _equal_lists(numbered, F.when(F.col("ordered"), F.col("row_no").cast("long")).otherwise(F.col("sorted_no")))


def fingerprint_match(rows: DataFrame) -> DataFrame:
    """(sample_id, maybe): False where the two sides can't hold the same rows.

    The fingerprint of a side is the number of its rows and the sums of both halves of their hashes, which don't depend on the
    order. Sides with equal lists have equal fingerprints, so different ones settle a mismatch for good, in any order; only
    equal ones are left to compare. One aggregate with map-side combine: a result of any size is three numbers a task.
    """
    h = F.xxhash64("row_key")
    sign = F.when(F.col("side") == "pred", F.lit(1)).otherwise(F.lit(-1)).cast("long")
    parts = [sign, sign * h.bitwiseAND(F.lit(0xFFFFFFFF)), sign * F.shiftrightunsigned(h, 32)]
    sums = _keyed(rows).groupBy("sample_id").agg(*(F.sum(p.cast("decimal(20,0)")).alias(f"s{k}") for k, p in enumerate(parts)))
    return sums.select("sample_id", ((F.col("s0") == 0) & (F.col("s1") == 0) & (F.col("s2") == 0)).alias("maybe"))


def _row_match(rows: DataFrame, sides: DataFrame, pred_flag: str, gold_flag: str) -> DataFrame:
    """Match per sample; sides flagged ordered keep row order, others are sorted.

    Rows are compared only where the fingerprints of both sides agree (:func:`fingerprint_match`).
    """
    first = materialize(fingerprint_match(rows), "row-fingerprints")
    flags = sides.select("sample_id", F.col(pred_flag).alias("po"), F.col(gold_flag).alias("go")) \
        .join(first.filter("maybe").select("sample_id"), "sample_id")
    settled = first.filter(~F.col("maybe")).select("sample_id", F.lit(False).alias("same"))
    alike = _same_order_match(rows, flags.filter(F.col("po") == F.col("go")).select("sample_id", F.col("po").alias("ordered")))
    if pred_flag == gold_flag:
        return settled.unionByName(alike)
    mixed = _mixed_match(rows, flags.filter(F.col("po") != F.col("go")))
    return settled.unionByName(alike).unionByName(mixed)


def execution_match(rows: DataFrame, status: DataFrame) -> DataFrame:
    """E5: both sides ran; each side sorted by row text unless its own SQL has 'order by'; lists equal.

    Returns one row per sample of ``status``; samples whose sides have no rows
    compare equal (left join back, so they are not lost).
    """
    sides = _sides(status)
    match = _row_match(rows, sides, "pred_ordered", "gold_ordered")
    return (sides.join(match, "sample_id", "left")
            .select("sample_id", (F.coalesce(F.col("pred_ok"), F.lit(False)) & F.coalesce(F.col("gold_ok"), F.lit(False))
                                  & F.coalesce(F.col("same"), F.lit(True))).alias("ex")))


def difficulty_breakdown(df: DataFrame, flag: str = "ex", difficulty: str = "difficulty",
                         all_label: str = "all") -> DataFrame:
    """Correct, total and accuracy per difficulty (absent -> 'unknown'), plus an overall line."""
    d = df.withColumn("_d", F.coalesce(F.col(difficulty), F.lit("unknown")))
    out = d.rollup("_d").agg(F.count_if(F.col(flag)).alias("correct"), F.count(F.lit(1)).alias("total"),
                             F.grouping("_d").alias("_all"))
    return out.select(F.when(F.col("_all") == 1, F.lit(all_label)).otherwise(F.col("_d")).alias("difficulty"),
                      "correct", "total",
                      F.round(F.col("correct") / F.col("total"), 9).alias("accuracy"))


def eval_details(samples: DataFrame, preds: DataFrame, ex: DataFrame) -> DataFrame:
    """One row per sample with pred/gold SQL, ex and em (key joins instead of positional zip)."""
    d = (samples.join(preds.select("sample_id", "pred_sql"), "sample_id", "left")
         .join(ex, "sample_id", "left")
         .withColumn("pred_sql", F.coalesce("pred_sql", F.lit("")))
         .withColumn("gold_sql", F.col("query")))
    d = exact_match(d)
    return d.select("sample_id", "db_id", "question", "evidence", "difficulty", "gold_sql", "pred_sql",
                    F.coalesce(F.col("ex"), F.lit(False)).alias("ex"), "em")


def eval_summary(details: DataFrame) -> DataFrame:
    """Overall ex/em rates and per-difficulty execution accuracy as one long table."""
    overall = details.agg(
        F.lit("overall").alias("scope"), F.lit("").alias("difficulty"),
        F.count_if("ex").alias("correct"), F.count(F.lit(1)).alias("total"),
        F.coalesce(F.round(F.avg(F.col("ex").cast("double")), 9), F.lit(0.0)).alias("ex_rate"),
        F.coalesce(F.round(F.avg(F.col("em").cast("double")), 9), F.lit(0.0)).alias("em_rate"))
    per = details.groupBy(F.coalesce("difficulty", F.lit("unknown")).alias("difficulty")).agg(
        F.count_if("ex").alias("correct"), F.count(F.lit(1)).alias("total"),
        F.round(F.avg(F.col("ex").cast("double")), 9).alias("ex_rate"),
        F.round(F.avg(F.col("em").cast("double")), 9).alias("em_rate")).withColumn("scope", F.lit("difficulty"))
    return overall.unionByName(per)


def pair_results(pairs: DataFrame, status: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Map per-query results (by sql_id) back to samples: long rows and statuses with side pred/gold.

    ``pairs`` has (sample_id, pred_sql, gold_sql) and, where texts ran per database, db_id; ``status`` and
    ``rows`` come from ``run_sql_batch``. A query shared by many samples ran once.
    """
    from .execute import sql_id_col
    db = F.col("db_id") if "db_id" in pairs.columns else F.lit(None).cast("string")
    side = F.explode(F.array(F.struct(F.lit("pred").alias("side"), F.col("pred_sql").alias("sql")),
                             F.struct(F.lit("gold").alias("side"), F.col("gold_sql").alias("sql"))))
    sides = pairs.select("sample_id", db.alias("db_id"), side.alias("s")).select("sample_id", "db_id", "s.*") \
        .withColumn("sql_id", sql_id_col("sql", "db_id"))
    ran = status.select("sql_id", "status", "error", *[c for c in ("planned",) if c in status.columns])
    st = sides.join(ran, "sql_id", "left") \
        .withColumn("status", F.coalesce("status", F.lit("error"))).withColumn("error", F.coalesce("error", F.lit("not run"))) \
        .select("sample_id", "side", "status", "sql", "error", *[c for c in ("planned",) if c in status.columns])
    rw = sides.join(rows, "sql_id").select("sample_id", "side", *[c for c in rows.columns if c != "sql_id"])
    return rw, st
