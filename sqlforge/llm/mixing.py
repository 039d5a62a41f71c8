"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 8).

Every document gets the exponential key -ln(u) / q, with u fixed by its id and text and q its
quality weight; taking documents in ascending key order is weighted sampling without
replacement. A source whose target is r times its size passes through floor(r) complete epochs;
the rest of its target is a prefix of its documents in key order.

Scale. No source is ever sorted as a whole. Keys are cut into buckets of about ``BUCKET_ROWS``
documents by a monotone map, words are summed per (source, bucket), and a running sum over those
sums finds the one bucket in which a source's budget ends. Only that bucket is ordered. What the
documents need is then one small row per source (epochs, boundary key, words left at the
boundary), so the documents are read again, not shuffled.

Defined results:
- null text: size 0; null source: a source of its own, last in the order;
- a source without words has target 0; an empty table gives an empty result;
- rows alike in id, source and text share one key; if the budget ends among them each takes the
  same share, rounded down;
- the document at the boundary gives only the words still missing (its first ones);
- an input column named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import WORD, documents, materialize, n_words, sized, uniform, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5        # all targets together, as a share of all sizes
MOST = 2.0         # a target is at most so many times its source's size
BUCKET_ROWS = 4096
SEED = "mix-8"
NO_LETTER = r"[^\p{L}\p{M}]+"      # letters and marks of any script
HALF_LENGTH = 40.0                  # words of a text whose length counts half
LEAST_WEIGHT = 0.05


def quality_weight(size: Column, text: Column) -> Column:
    """Between ``LEAST_WEIGHT`` and 1, from what a text is like, in any script: the product of

    - its share of letters among the characters of its words (symbols, digits and marks lower it);
    - its variety, ln(1 + different words) / ln(1 + words) (repetition lowers it);
    - its length, words / (words + ``HALF_LENGTH``).
    """
    def weigh(words):
        # Several uses of one list: bound once per row.
        chars = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)).cast("double")
        variety = F.log(F.size(F.array_distinct(words)) + F.lit(1.0)) / F.log(F.size(words) + F.lit(1.0))
        return F.struct(chars.alias("chars"), variety.alias("variety"))

    seen = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), weigh)
    letters = F.length(F.regexp_replace(text, NO_LETTER, "")).cast("double")
    value = let(seen, lambda s: letters / s["chars"] * s["variety"] * (size / (size + F.lit(HALF_LENGTH))))
    return F.when(size > 0, F.lit(LEAST_WEIGHT) + F.lit(1 - LEAST_WEIGHT) * value).otherwise(F.lit(LEAST_WEIGHT))


def keyed(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with size, ``_src``, ``_tie`` and ``_key`` (ascending = taken first)."""
    text = whole_text(text_col)
    cols = docs.columns if keep is None else keep
    cols = [c for c in cols if c.lower() not in ("size", "_src", "_has_src", "_tie", "_key")]
    out = docs.select(*cols, F.coalesce(F.col(source_col), F.lit("")).alias("_src"),
                      F.col(source_col).isNotNull().alias("_has_src"),
                      n_words(text_col).alias("size"),
                      F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                                  F.md5(text)).alias("_tie"),
                      quality_weight(n_words(text_col), text).alias("_q"))
    return out.withColumn("_key", -F.log(uniform(F.col("_tie"))) / F.col("_q")).drop("_q")


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of each source: weight times one common level, at most ``most`` times its size.

    With sources ordered by size / weight those at their limit come first; the level is fixed by the
    first source that stays under its limit. One row per source, so global windows are small.
    """
    order = Window.orderBy(F.col("_has_src").desc(), "_src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = per_source.withColumn("_w", w).withColumn("_limit", F.lit(most) * F.col("source_size"))
    whole = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("_has_src").desc(), "_src")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("_all", F.sum("source_size").over(everything) * F.lit(share))
         .withColumn("_capped", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
         .withColumn("_free_w", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    t = t.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_free_w"))
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_limit"), F.struct(F.col("_limit") / F.col("_w"), "_level"))
                  ).over(everything)["_level"]
    t = t.withColumn("_cut", level)
    return t.withColumn("target", F.least(F.col("_limit"), F.coalesce(F.col("_cut") * F.col("_w"), F.col("_limit")))) \
        .drop("_w", "_limit", "_all", "_capped", "_free_w", "_level", "_cut")


def plan_mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
             bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per source: target, epochs, boundary (key, tie) and the words it gives there."""
    src = ["_src", "_has_src"]
    per = rows.groupBy(*src).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    t = targets(per, weights, share, most)
    size = F.col("source_size")
    # The rounded target: half a word below a whole epoch is that epoch, so the budget is always less than the source.
    epochs = F.when(size > 0, F.floor(F.round("target") / size)).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("_epochs", epochs) \
        .withColumn("_budget", F.greatest(F.round("target").cast("long") - F.col("_epochs") * size, F.lit(0).cast("long"))) \
        .withColumn("_buckets", F.ceil(F.col("_n") / F.lit(bucket_rows)))
    t = sized(t, "mix-sources")
    spread = F.lit(1.0) - F.exp(-F.col("_key"))
    dealt = rows.select(*src, "size", "_key", "_tie").join(t.select(*src, "_buckets", "_budget"), src) \
        .withColumn("_bucket", F.least(F.floor(spread * F.col("_buckets")), F.col("_buckets") - 1))
    sums = dealt.groupBy(*src, "_bucket", "_budget").agg(F.sum("size").alias("_words"))
    run = Window.partitionBy(*src).orderBy("_bucket")
    sums = sums.withColumn("_before", F.sum("_words").over(run) - F.col("_words"))
    edge = sized(sums.filter((F.col("_before") <= F.col("_budget")) & (F.col("_budget") < F.col("_before") + F.col("_words")))
                 .select(*src, "_bucket", "_before"), "mix-edges")
    # Rows alike in key and tie are summed first, so repeated rows never fill one window.
    inside = dealt.join(edge, [*src, "_bucket"]).groupBy(*src, "_budget", "_before", "_key", "_tie", "size") \
        .agg(F.count(F.lit(1)).alias("_alike"))
    order = Window.partitionBy(*src).orderBy("_key", "_tie", "size")
    words = F.col("size") * F.col("_alike")
    inside = inside.withColumn("_end", F.col("_before") + F.sum(words).over(order)) \
        .filter((F.col("_budget") >= F.col("_end") - words) & (F.col("_budget") < F.col("_end")))
    cut = inside.select(*src, F.col("_key").alias("_cut_key"), F.col("_tie").alias("_cut_tie"),
                        F.floor((F.col("_budget") - (F.col("_end") - words)) / F.col("_alike")).cast("long").alias("_cut_words"))
    return sized(t.join(cut, src, "left").select(*src, "source_size", "target", "_epochs", "_cut_key", "_cut_tie", "_cut_words"),
                 "mix-plan")


def mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and taken to keyed rows."""
    key, cut = F.struct("_key", "_tie"), F.struct(F.col("_cut_key"), F.col("_cut_tie"))
    # No boundary: the source has no words.
    part = F.when(F.col("_cut_key").isNull(), F.lit(0).cast("long")) \
        .when(key < cut, F.col("size")).when(key == cut, F.col("_cut_words")).otherwise(F.lit(0).cast("long"))
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("source_size", "target", "taken")])
    return rows.join(plan, ["_src", "_has_src"]) \
        .withColumn("taken", F.col("_epochs") * F.col("size") + part) \
        .drop("_src", "_has_src", "_key", "_tie", "_epochs", "_cut_key", "_cut_tie", "_cut_words")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(keyed(documents(spark, sf_dir), keep=["doc_id", "source"]), "mix-keys")
    return mix(rows, plan_mix(rows)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with all their columns: complete copies, then the part of the document at the boundary.

    Documents of which nothing is taken go; documents without words are never taken.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text", "source")
    plan = plan_mix(materialize(keyed(docs, keep=[]), "mix-keys"))
    out = mix(keyed(whole, keep=["_doc"]), plan).filter(F.col("taken") > 0)
    full, rest = F.floor(F.col("taken") / F.col("size")), F.pmod(F.col("taken"), F.col("size"))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), full.cast("int")),
                      F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_part", F.explode(copies))
    cut = first_words("_doc.text", F.col("_part"))
    part = F.col("_doc").withField("text", cut)
    if "n_chars" in {c.lower() for c in docs.columns}:
        part = part.withField("n_chars", F.length(cut).cast(docs.schema["n_chars"].dataType))
    return out.select(F.when(F.col("_part") < 0, F.col("_doc")).otherwise(part).alias("_doc")).select("_doc.*")


def first_words(col: str, n: Column) -> Column:
    """A text up to its n-th word."""
    pieces = F.regexp_extract_all(F.col(col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.concat_ws("", F.slice(pieces, F.lit(1), n.cast("int")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NOT NULL AS has_src,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{M}]+', '', 'g'))::DOUBLE AS letters,
         'mix-8|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS tie
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5(tie), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / CASE WHEN size > 0 THEN 0.05::DOUBLE + 0.95::DOUBLE * (letters / list_sum(list_transform(words, lambda w: length(w)))::DOUBLE
                * (ln(len(list_distinct(words)) + 1.0::DOUBLE) / ln(size + 1.0::DOUBLE)) * (size / (size + 40.0::DOUBLE))) ELSE 0.05::DOUBLE END AS key FROM d),
s AS (
  SELECT src, has_src, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY has_src DESC, src) - 1) % 3 + 1)::INT] AS w
  FROM k GROUP BY src, has_src),
s2 AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, has_src DESC, src
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, has_src DESC, src
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS free_w
  FROM s),
s3 AS (SELECT *, (total - capped) / free_w AS level FROM s2),
c AS (SELECT arg_min(level, lim / w) AS cut FROM s3 WHERE level * w <= lim),
t AS (SELECT src, has_src, source_size, least(lim, coalesce(cut * w, lim)) AS target FROM s3, c),
t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
t3 AS (SELECT *, greatest(round(target)::BIGINT - epochs * source_size, 0) AS budget FROM t2),
r AS (
  SELECT k.doc_id, k.size, t3.source_size, t3.target, t3.epochs, t3.budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.src, k.has_src ORDER BY k.key, k.tie
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN t3 ON k.src = t3.src AND k.has_src = t3.has_src)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(budget - before, 0)))::BIGINT AS taken
FROM r
"""
QUERIES = {"op8_mix_sources": op8_mix_sources}
ORACLES = {"op8_mix_sources": ORACLE}
