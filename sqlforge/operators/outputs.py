"""Parsing model outputs at table level: P5 columns and the P7 quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clauses import assemble_sql, extract_clauses, extract_summary, missing_tags


def parse_outputs(df: DataFrame, text: str = "output") -> DataFrame:
    """Adds clauses, summary, assembled SQL and the final SQL (summary first)."""
    return (df.withColumn("clauses", extract_clauses(F.col(text)))
            .withColumn("summary", extract_summary(F.col(text)))
            .withColumn("assembled", assemble_sql(F.col("clauses")))
            .withColumn("final_sql", F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("assembled"))))


def output_quality(df: DataFrame, text: str = "output", by: str = "source") -> DataFrame:
    """Per group: outputs, with summary, assembled fallback, neither, mean missing tags."""
    p = parse_outputs(df, text)
    has_sum = F.col("summary") != ""
    return p.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_outputs"),
        F.count_if(has_sum).alias("n_summary"),
        F.count_if(~has_sum & (F.col("assembled") != "")).alias("n_assembled"),
        F.count_if(~has_sum & (F.col("assembled") == "")).alias("n_empty"),
        F.round(F.avg(missing_tags(F.col(text))), 9).alias("avg_missing_tags"))
