"""Splittable reader for JSON arrays of objects.

Spark's multi-line JSON reader takes a file as one record and so as one task. Here the text reader cuts a
file at every ``{`` (its line separator, which it finds from any byte range), and what a cut means is
found by prefix scans over the pieces in file order:

- a piece begins inside a string if the quotes before it are odd in number (escaped characters don't count);
- the braces and brackets outside strings, summed, give how deep a piece begins;
- a piece that begins a new object at the wanted depth begins a record; its number is the count of such pieces so far.

Each scan is a window inside one split of a file, plus one row per split for what the splits before it add. A split is
summed up for both cases, beginning inside a string and outside, so that one pass over the pieces is enough. The pieces of a
record (bounded by the record) are put together again and parsed. Records keep their order in the file, files that of their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_AT = ["file", "block"]       # a split of a file


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _outside(clean: Column, in_string: bool) -> Column:
    """A piece without escaped characters, less its strings; the last one may be open."""
    text = F.concat(F.lit('"'), clean) if in_string else clean
    return F.regexp_replace(text, '"[^"]*("|$)', "")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, mid, value, q, and for both cases 0 and 1 the braces c and brackets b that close or open in it)."""
    raw = spark.read.option("lineSep", "{").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    clean = raw.withColumn("_clean", F.regexp_replace("value", r"(?s)\\.", ""))
    cases = clean.withColumns({"_o0": _outside(F.col("_clean"), False), "_o1": _outside(F.col("_clean"), True)})
    return cases.select(*_AT, "mid", "value", _count(F.col("_clean"), '"').alias("q"),
                        *(_count(F.col(f"_o{s}"), "}").alias(f"c{s}") for s in (0, 1)),
                        *((_count(F.col(f"_o{s}"), "[") - _count(F.col(f"_o{s}"), "]")).alias(f"b{s}") for s in (0, 1)))


def _before(table: DataFrame, value: Column, order: str, part: list[str]) -> Column:
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _opens(state: Column) -> Column:
    """1 if the { before a piece is a brace: outside a string, and not the very beginning of a file."""
    return F.when((state == 0) & ~F.col("begin"), 1).otherwise(0)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, depth: int = 0, in_array: bool = False) -> DataFrame:
    """(record, ...fields of schema): the objects that ``depth`` objects enclose (with ``in_array`` only those that stand in an array).

    ``record`` counts from 0 in file order. Text before and after the array is ignored; an element that isn't an
    object gives no record, one that can't be parsed gives nulls, as with Spark's own reader.
    """
    pieces = materialize(_pieces(spark, path), "json-pieces")
    # No { stands before the first piece of a file.
    starts = pieces.groupBy("file").agg(F.min_by("mid", F.struct("block", "mid")).alias("_first"))
    p = pieces.join(F.broadcast(starts), "file").withColumn("begin", F.col("mid") == F.col("_first")).drop("_first")
    parity = F.pmod(_before(p, F.col("q"), "mid", _AT), F.lit(2))
    p = p.withColumn("p", parity)
    # A split's sums for both cases; s is the case of a piece, t that of its split.
    sums = []
    for t in (0, 1):
        s = F.pmod(F.col("p") + t, F.lit(2))
        sums += [F.sum(_opens(s) - F.when(s == 0, F.col("c0")).otherwise(F.col("c1"))).alias(f"d{t}"),
                 F.sum(F.when(s == 0, F.col("b0")).otherwise(F.col("b1"))).alias(f"a{t}")]
    splits = p.groupBy(*_AT).agg(F.sum("q").alias("q"), *sums)
    splits = splits.withColumn("t", F.pmod(_before(splits, F.col("q"), "block", ["file"]), F.lit(2)))
    splits = splits.withColumns({n: F.when(F.col("t") == 0, F.col(f"{n}0")).otherwise(F.col(f"{n}1")) for n in ("d", "a")})
    splits = splits.select(*_AT, "t", _before(splits, F.col("d"), "block", ["file"]).alias("depth"), _before(splits, F.col("a"), "block", ["file"]).alias("arrays"))
    splits = materialize(splits.coalesce(1), "json-splits")

    p = p.join(F.broadcast(splits), _AT).withColumn("s", F.pmod(F.col("p") + F.col("t"), F.lit(2)))
    p = p.withColumns({"open": _opens(F.col("s")), "close": F.when(F.col("s") == 0, F.col("c0")).otherwise(F.col("c1")),
                       "array": F.when(F.col("s") == 0, F.col("b0")).otherwise(F.col("b1"))})
    p = p.withColumns({"depth": F.col("depth") + _before(p, F.col("open") - F.col("close"), "mid", _AT),
                       "arrays": F.col("arrays") + _before(p, F.col("array"), "mid", _AT)})
    starts_here = (F.col("open") == 1) & (F.col("depth") == depth) & (F.col("arrays") > (0 if in_array else -1))
    run = Window.partitionBy(*_AT).orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("new", starts_here.cast("int"))
    # A piece belongs to a record as long as it begins inside the object or with its brace.
    p = p.withColumn("inside", (F.col("new") == 1) | (F.col("depth") > depth)).withColumn("nth", F.sum("new").over(run))
    marked = materialize(p.select(*_AT, "mid", "value", "new", "nth", "inside"), "json-marked")
    per = marked.groupBy(*_AT).agg(F.sum("new").alias("n"))
    offsets = per.select(*_AT, F.coalesce(F.sum("n").over(Window.orderBy(*_AT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    records = marked.filter("inside").join(F.broadcast(offsets), _AT).withColumn("record", F.col("off") + F.col("nth") - 1).filter("record >= 0") \
        .groupBy("record").agg(F.array_sort(F.collect_list(F.struct("block", "mid", "value"))).alias("ps"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("ps", lambda x: x["value"]), "{"))
    return records.select("record", F.from_json(F.rtrim(text, F.lit(",] \n\r\t")), schema).alias("v")).select("record", "v.*")
