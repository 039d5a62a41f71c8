"""Scoring model outputs as they arrive.

The reference has no stream; every step of output parsing and text scoring
is a per-row column expression, so the same expressions apply unchanged to a
Structured Streaming source (files landing in a folder, a message bus). No
state is kept. Micro-batches go to Spark's Parquet sink, whose log makes a
replayed batch count once; every stream needs a checkpoint folder of its own, from which a restarted
query resumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clauses import extract_reflection, format_score
from ..operators.outputs import parse_outputs

OUTPUT_SCHEMA = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("output", T.StringType())])


def scored_outputs(stream: DataFrame, text: str = "output") -> DataFrame:
    """Final SQL, reflection answer and format score of every arriving output (stateless)."""
    p = parse_outputs(stream, text)
    return p.select("sample_id", "final_sql", extract_reflection(F.col(text))["answer"].alias("answer"),
                    format_score(F.col(text)).alias("r_format"))


def start_output_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                         fmt: str = "json", available_now: bool = True):
    """Read output files from ``source_dir`` as a stream, score them, append to Parquet at ``sink_dir``."""
    src = spark.readStream.schema(OUTPUT_SCHEMA).format(fmt).load(source_dir)
    w = scored_outputs(src).writeStream.format("parquet").outputMode("append") \
        .option("path", sink_dir).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
