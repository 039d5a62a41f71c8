"""Sources and sinks S1, S2, S4-S8: JSON corpora, JSON Lines, evaluation reports."""

from __future__ import annotations

import hashlib
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_array import read_json_array

log = logging.getLogger(__name__)

QA_RAW_SCHEMA = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("SQL", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("difficulty", T.StringType()),
])

SAMPLE_SCHEMA = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("difficulty", T.StringType()),
])

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
SFT_SCHEMA = T.StructType([
    T.StructField("system", T.StringType()),
    T.StructField("conversations", T.ArrayType(MESSAGE)),
    T.StructField("db_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("query", T.StringType()),
])

DETAIL_SCHEMA = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("gold_sql", T.StringType()),
    T.StructField("pred_sql", T.StringType()),
    T.StructField("ex", T.BooleanType()),
    T.StructField("em", T.BooleanType()),
])



def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the path (works for HDFS/object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, reader) -> DataFrame:
    """Read ``path`` with ``reader``; a missing path gives a warning and no rows."""
    if not path_exists(spark, path):
        log.warning("missing input %s, using no rows", path)
        return spark.createDataFrame([], schema)
    return reader(path)


_ID_BITS = 43      # of a sample id: place in its input; the bits above name the input


def _input_number(source: str, split: str, path: str) -> int:
    return int(hashlib.md5(f"{source}\n{split}\n{path}".encode()).hexdigest(), 16) % (1 << (63 - _ID_BITS))


def read_qa_json(spark: SparkSession, path: str, source: str, split: str = "train",
                 with_evidence: bool = False, number: int | None = None) -> DataFrame:
    """A JSON array of samples, or JSON Lines (``.jsonl``), both read in splits -> rows of SAMPLE_SCHEMA.

    The SQL text is taken from ``SQL``, else ``query``, else ''. Evidence and
    difficulty default to ''. ``sample_id`` keeps the file order below a prefix that names the input, so
    samples of several inputs never share an id: ``number`` (give each input its own), else a hash of
    (source, split, path).
    """
    first = (_input_number(source, split, path) if number is None else number) << _ID_BITS

    def reader(p):
        if p.rstrip("/").endswith((".jsonl", ".jsonl.gz")):
            raw = spark.read.schema(QA_RAW_SCHEMA).json(p).withColumn("record", F.monotonically_increasing_id())
        else:
            raw = read_json_array(spark, p, QA_RAW_SCHEMA)
        sql = F.coalesce(F.col("SQL"), F.col("query"), F.lit("")) if with_evidence \
            else F.coalesce(F.col("query"), F.lit(""))
        return raw.select(
            (F.lit(first) + F.col("record")).alias("sample_id"),
            F.lit(source).alias("source"), F.lit(split).alias("split"),
            F.coalesce("db_id", F.lit("")).alias("db_id"),
            F.coalesce("question", F.lit("")).alias("question"),
            sql.alias("query"),
            (F.coalesce("evidence", F.lit("")) if with_evidence else F.lit("")).alias("evidence"),
            (F.coalesce("difficulty", F.lit("")) if with_evidence else F.lit("")).alias("difficulty"),
        )
    return read_or_empty(spark, path, SAMPLE_SCHEMA, reader)


def coalesce_sql_field(df: DataFrame) -> DataFrame:
    """The SQL text of a raw row: ``SQL``, else ``query``, else ''."""
    return df.withColumn("query", F.coalesce(F.col("SQL"), F.col("query"), F.lit(""))).drop("SQL")


def write_split(df: DataFrame, out: str, fmt: str = "json") -> None:
    """One folder per split (JSON Lines, UTF-8 unescaped, one object per line)."""
    df.write.mode("overwrite").partitionBy("split").format(fmt).save(out)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = SFT_SCHEMA) -> DataFrame:
    """One object per line; blank lines and rows without any field are dropped."""
    df = read_or_empty(spark, path, schema, lambda p: spark.read.schema(schema).json(p))
    return df.dropna(how="all")


def read_stage1(spark: SparkSession, path: str) -> DataFrame:
    """The details of an evaluation report: (detail_ord, ...detail columns).

    A folder that :func:`write_eval_report` wrote is read line by line (``details/`` below ``path``, or that
    folder itself), and ``detail_ord`` is the sample's id. A single ``{"details": [...]}`` document is
    imported too. Any other layout is an error.
    """
    empty = T.StructType([T.StructField("detail_ord", T.LongType())] + DETAIL_SCHEMA.fields)
    if not path_exists(spark, path):
        return read_or_empty(spark, path, empty, None)
    base = path.rstrip("/")
    folder = f"{base}/details" if path_exists(spark, f"{base}/details") else base if base.endswith("/details") else None
    if folder:
        lines = spark.read.schema(T.StructType([T.StructField("sample_id", T.LongType())] + DETAIL_SCHEMA.fields)).json(folder)
        return lines.select(F.coalesce("sample_id", F.monotonically_increasing_id()).alias("detail_ord"),
                            *[f.name for f in DETAIL_SCHEMA.fields])
    # Details are the objects in an array of the one report object; the reader takes them from any split.
    if spark.read.option("lineSep", "{").text(path).filter(F.col("value").rlike(r'"details"\s*:\s*\[')).isEmpty():
        raise ValueError(f"{path} holds no evaluation report: neither a details folder nor a document with details")
    return read_json_array(spark, path, DETAIL_SCHEMA, depth=1, in_array=True).withColumnRenamed("record", "detail_ord")


def write_eval_report(details: DataFrame, summary: DataFrame, out: str, fmt: str = "json") -> None:
    """Detail rows and summary rows as two outputs below ``out``."""
    details.write.mode("overwrite").format(fmt).save(f"{out.rstrip('/')}/details")
    summary.coalesce(1).write.mode("overwrite").format(fmt).save(f"{out.rstrip('/')}/summary")
