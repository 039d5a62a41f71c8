"""Helpers shared by the training-data operators: word pattern, table access, small-table joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, read_table

# A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def whole_text(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def n_words(col: str = "text") -> Column:
    """Number of words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A uniform number in (0, 1) fixed by the given values: 52 bits of their MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def sized(df: DataFrame, name: str) -> DataFrame:
    """Write a small table to the shared folder and read it back.

    A written table has a known size, so a join with it is a broadcast only if Spark's own
    byte check (``autoBroadcastJoinThreshold``) allows that, and a shuffle join otherwise.
    """
    return materialize(df.coalesce(1), name)


def spread() -> dict[str, Column]:
    """Columns behind doc_id in a range partitioning, so that rows of one id, or without one, are several ranges:
    a hash of the text, and a number of the row for rows that are equal in both."""
    return {"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}


# What a Python worker keeps from one task to the next, by name. A worker outlives a query, so a task
# that needs memory of its own empties these first.
WORKER_CACHES: dict = {}


def release_caches() -> None:
    if WORKER_CACHES:
        import gc
        WORKER_CACHES.clear()
        gc.collect()


__all__ = ["WORD", "WORKER_CACHES", "documents", "materialize", "n_words", "read_table", "release_caches", "sized", "spread", "uniform", "whole_text"]
