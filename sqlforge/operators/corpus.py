"""Corpus preparation C2-C12: samples -> clause-tagged training examples and reports.

All steps are projections, filters, unions and aggregates; the only join is
samples x per-database schema text (one row per database), which the planner
broadcasts by its own size check when the text table is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLAUSES, KEY_MARK, SYSTEM_TEXT
from ..functions.clauses import clause_output, split_clauses
from ..functions.prompts import chat_messages, sft_user_text
from ..session import materialize


def unify_corpora(*dfs: DataFrame) -> DataFrame:
    """Union by column name; columns missing in one corpus are filled with ''."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    strings = [f.name for f in out.schema.fields if f.dataType.simpleString() == "string"]
    return out.fillna("", subset=strings)


def with_clauses(df: DataFrame, sql_col: str = "query", out: str = "clauses") -> DataFrame:
    """C1 applied to a table: adds the struct of eight clauses."""
    return df.withColumn(out, split_clauses(F.col(sql_col)))


def serialize_schema_typed(catalog: DataFrame) -> DataFrame:
    """Per database, one line 'Table t: (col type, ...)' per table, tables in order."""
    per_table = (catalog.groupBy("db_id", "table_ord", "table_name")
                 .agg(F.array_sort(F.collect_list(F.struct("col_ord", F.concat_ws(" ", "col_name", "col_type").alias("t"))))
                      .alias("cols"))
                 .select("db_id", "table_ord",
                         F.concat(F.lit("Table "), F.col("table_name"), F.lit(": ("),
                                  F.array_join(F.transform("cols", lambda c: c["t"]), ", "), F.lit(")")).alias("line")))
    return (per_table.groupBy("db_id")
            .agg(F.array_sort(F.collect_list(F.struct("table_ord", "line"))).alias("lines"))
            .select("db_id", F.array_join(F.transform("lines", lambda c: c["line"]), "\n").alias("schema")))


def serialize_schema(catalog: DataFrame, fks: DataFrame | None = None, compact: bool = False) -> DataFrame:
    """C4: compact 't(c1 [PK], c2)' lines or 'Table t:' with '  - col' bullets; then the foreign-key block."""
    col_text = F.concat(F.col("col_name"), F.when(F.col("is_pk"), F.lit(KEY_MARK)).otherwise(F.lit("")))
    per_table = catalog.groupBy("db_id", "table_ord", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("col_ord", col_text.alias("t")))).alias("cols"))
    names = F.transform("cols", lambda c: c["t"])
    if compact:
        text = F.concat(F.col("table_name"), F.lit("("), F.array_join(names, ", "), F.lit(")"))
    else:
        text = F.concat(F.lit("Table "), F.col("table_name"), F.lit(":"),
                        F.when(F.size(names) > 0,
                               F.concat(F.lit("\n  - "), F.array_join(names, "\n  - "))).otherwise(F.lit("")))
    tables = (per_table.groupBy("db_id")
              .agg(F.array_sort(F.collect_list(F.struct("table_ord", text.alias("t")))).alias("ts"))
              .select("db_id", F.array_join(F.transform("ts", lambda c: c["t"]), "\n").alias("schema")))
    if fks is None:
        return tables
    fk_text = (fks.groupBy("db_id")
               .agg(F.array_sort(F.collect_list(F.struct(
                   "fk_ord", F.concat(F.lit("  "), "t1", F.lit("."), "c1", F.lit(" = "), "t2", F.lit("."), "c2")
                   .alias("t")))).alias("fs"))
               .select("db_id", F.array_join(F.transform("fs", lambda c: c["t"]), "\n").alias("fk")))
    return (tables.join(fk_text, "db_id", "left")
            .select("db_id", F.when(F.col("fk").isNotNull(),
                                    F.concat("schema", F.lit("\n\nForeign Keys:\n"), "fk"))
                    .otherwise(F.col("schema")).alias("schema")))


def attach_schema(samples: DataFrame, schema_text: DataFrame) -> DataFrame:
    """Schema text per sample by db_id (unknown database -> '').

    The schema table (one row per database) is written once, so Spark knows its size in bytes and
    broadcasts it only within its own threshold; beyond that the join is an ordinary shuffle join, whose
    hot databases adaptive execution splits.
    """
    right = materialize(schema_text.withColumnRenamed("schema", "_schema").coalesce(1), "schema-text")
    return (samples.join(right, "db_id", "left")
            .withColumn("schema", F.coalesce("_schema", F.lit(""))).drop("_schema"))


def build_sft(samples: DataFrame, system: str = SYSTEM_TEXT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop rows with an empty question or query; emit system text, [user, assistant] turns (and ``keep`` columns)."""
    s = samples if "clauses" in samples.columns else with_clauses(samples)
    user = sft_user_text(F.col("schema"), F.col("evidence"), F.col("question"))
    assistant = clause_output(F.col("clauses"), F.col("query"))
    return (s.filter((F.col("question") != "") & (F.col("query") != ""))
            .select("sample_id", "split", F.lit(system).alias("system"),
                    F.array(F.struct(F.lit("user").alias("role"), user.alias("content")),
                            F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))
                    .alias("conversations"),
                    "db_id", "source", "query", *keep))


def sft_counts(samples: DataFrame) -> DataFrame:
    """Raw and kept rows per corpus and split."""
    kept = (F.col("question") != "") & (F.col("query") != "")
    return samples.groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if(kept).alias("n_kept"))


def shuffle_train(sft: DataFrame, seed: int = 42) -> DataFrame:
    """C11: train rows in a reproducible shuffled order (rank by md5 of seed and id); dev keeps its order."""
    key = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col("sample_id").cast("string")))
    return sft.withColumn("shuffle_key", F.when(F.col("split") == "train", key)
                          .otherwise(F.lpad(F.col("sample_id").cast("string"), 20, "0")))


def clause_profile(df: DataFrame) -> DataFrame:
    """Per source, split and clause: samples using the clause and all samples."""
    s = df if "clauses" in df.columns else with_clauses(df)
    long = s.select("source", "split", F.explode(F.array(*[
        F.struct(F.lit(c).alias("clause"), F.col("clauses")[c].alias("text")) for c in CLAUSES])).alias("c"))
    return long.groupBy("source", "split", F.col("c.clause").alias("clause")).agg(
        F.count_if(F.col("c.text") != "").alias("n_used"), F.count(F.lit(1)).alias("n_total"))


def chat_form(samples: DataFrame, system: str = SYSTEM_TEXT, user_col: str = "user_prompt") -> DataFrame:
    return samples.withColumn("messages", chat_messages(system, F.col(user_col)))
