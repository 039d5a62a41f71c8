"""Reward scoring W1-W9 as columns and key-joined aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ALL_TAGS, REWARD_WEIGHTS
from ..functions.clauses import format_score
from ..functions.text import let, ngrams, schema_tokens, whitespace_tokens
from ..session import materialize
from .evaluate import _row_match, _sides


def _f1(common: Column, n_pred: Column, n_gold: Column) -> Column:
    p = common / n_pred
    r = common / n_gold
    return F.when((p + r) == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def result_token_f1(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Multiset token F1 of all result cells (lower-case whitespace tokens, NULL is 'none').

    Gold without rows: 1.0 if pred has none else 0.0; both token-less: 1.0;
    one token-less: 0.0. Tokens are counted by a (sample, token) aggregate
    with map-side combine, so one huge result is no single task.
    """
    toks = rows.select("sample_id", "side", F.explode("cells").alias("cell")) \
        .select("sample_id", "side", F.explode(whitespace_tokens(F.col("cell"))).alias("tok"))
    per_tok = toks.groupBy("sample_id", "tok").agg(
        F.count_if(F.col("side") == "pred").alias("p"), F.count_if(F.col("side") == "gold").alias("g"))
    per_sample = per_tok.groupBy("sample_id").agg(
        F.sum(F.least("p", "g")).alias("common"), F.sum("p").alias("np"), F.sum("g").alias("ng"))
    n_rows = rows.groupBy("sample_id").agg(
        F.count_if(F.col("side") == "pred").alias("pred_rows"), F.count_if(F.col("side") == "gold").alias("gold_rows"))
    j = samples.select("sample_id").join(n_rows, "sample_id", "left").join(per_sample, "sample_id", "left") \
        .fillna(0, subset=["pred_rows", "gold_rows", "common", "np", "ng"])
    f1 = (F.when(F.col("gold_rows") == 0, F.when(F.col("pred_rows") == 0, 1.0).otherwise(0.0))
          .when((F.col("np") == 0) & (F.col("ng") == 0), 1.0)
          .when((F.col("np") == 0) | (F.col("ng") == 0), 0.0)
          .otherwise(_f1(F.col("common").cast("double"), F.col("np").cast("double"), F.col("ng").cast("double"))))
    return j.select("sample_id", f1.cast("double").alias("f1"))


def reward_execution(rows: DataFrame, status: DataFrame) -> DataFrame:
    """0 if either side failed; sort both sides unless the *pred* SQL has 'order by'; equal -> 1, else W1.

    The rows feed four branches, so they are made once. Their cells are counted (W1) only where both sides ran and differ.
    """
    rows = materialize(rows, "result-rows")
    sides = _sides(status).withColumn("both", F.col("pred_ordered"))
    match = materialize(sides.join(_row_match(rows, sides, "both", "both"), "sample_id", "left")
                        .select("sample_id", (~F.coalesce("pred_ok", F.lit(False)) | ~F.coalesce("gold_ok", F.lit(False))).alias("failed"),
                                F.coalesce("same", F.lit(True)).alias("same")), "row-matches")
    differ = match.filter(~F.col("failed") & ~F.col("same")).select("sample_id")
    f1 = result_token_f1(rows.join(differ, "sample_id", "left_semi"), differ)
    return match.join(f1, "sample_id", "left").select(
        "sample_id", F.when(F.col("failed"), F.lit(0.0)).when(F.col("same"), F.lit(1.0)).otherwise(F.col("f1")).alias("r_exec"))


def reward_format(text, tags=ALL_TAGS) -> Column:
    """Share of the required tags present in the output."""
    return format_score(text, tags)


def reward_schema(pred, gold) -> Column:
    """Jaccard of schema tokens; gold empty -> 1 if pred empty else 0.5; pred empty -> 0."""
    def score(pg):
        p, g = pg["p"], pg["g"]
        inter = F.size(F.array_intersect(p, g)).cast("double")
        union = F.size(F.array_union(p, g)).cast("double")
        return (F.when(F.size(g) == 0, F.when(F.size(p) == 0, 1.0).otherwise(0.5))
                .when(F.size(p) == 0, 0.0)
                .when(union > 0, inter / union).otherwise(0.0)).cast("double")
    return let(F.struct(schema_tokens(pred).alias("p"), schema_tokens(gold).alias("g")), score)


def reward_ngram(df: DataFrame, pred: str = "pred_sql", gold: str = "gold_sql", key: str = "sample_id", n: int = 2) -> DataFrame:
    """(key, r_ngram), the multiset F1 of word n-grams; gold empty -> 1 if pred empty else 0; pred empty -> 0.

    Texts meet by their key; a key's n-grams are counted in its own row, as runs of the sorted ones: no n-gram is a row.
    """
    def grams(side):
        return F.flatten(F.transform("_t", lambda t: ngrams(t[side], n)))

    def by_runs(p, q):
        both = F.sort_array(F.concat(F.transform(p, lambda g: F.struct(g.alias("g"), F.lit(1).alias("p"))),
                                     F.transform(q, lambda g: F.struct(g.alias("g"), F.lit(0).alias("p")))))

        def common(x):
            size = F.size(x)
            begins = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: (i == 1) | (F.get(x, i - 1)["g"] != F.get(x, i - 2)["g"]))
            runs = let(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(size + 1)), lambda a, z: F.slice(x, a, z - a)))
            return F.aggregate(runs, F.lit(0), lambda s, r: s + let(F.size(F.filter(r, lambda e: e["p"] == 1)), lambda m: F.least(m, F.size(r) - m)))
        return let(both, common)

    def once(x):
        return F.size(F.array_distinct(x)) == F.size(x)

    def counts(t):
        p, q = t["p"], t["q"]
        # Without a repeated n-gram on either side the multisets are sets.
        c = F.when(once(p) & once(q), F.size(F.array_intersect(p, q))).otherwise(by_runs(p, q))
        return F.struct(c.cast("double").alias("c"), F.size(p).cast("double").alias("p"), F.size(q).cast("double").alias("q"))

    per = df.groupBy(key).agg(F.collect_list(F.struct(F.col(pred).alias("p"), F.col(gold).alias("q"))).alias("_t"))
    t = per.select(key, let(F.struct(grams("p").alias("p"), grams("q").alias("q")), counts).alias("_c")).select(key, "_c.*")
    score = F.when(F.col("q") == 0, F.when(F.col("p") == 0, 1.0).otherwise(0.0)).when(F.col("p") == 0, 0.0) \
        .otherwise(_f1(F.col("c"), F.col("p"), F.col("q")))
    return t.select(key, score.cast("double").alias("r_ngram"))


def reward_total(df: DataFrame, weights: dict | None = None) -> DataFrame:
    """Weighted sum of r_exec, r_format, r_syntax, r_schema, r_ngram divided by the sum of weights."""
    w = dict(REWARD_WEIGHTS if weights is None else weights)
    total = sum(F.lit(float(w[k])) * F.col(f"r_{k}") for k in ("exec", "format", "syntax", "schema", "ngram"))
    return df.withColumn("r_total", total / F.lit(float(sum(w.values()))))

