"""Secret scan with corpus-wide ownership frequency (operator 3), all in DataFrame functions.

Every text is searched whole for candidates: three base kinds (assignments, access keys, hex runs)
and two that the method adds (keys with a vendor's prefix, random-looking tokens). The hash of a candidate's
value is then counted over the corpus by distinct owners and repositories. A value that at least
``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOSITORIES`` repositories hold is a widely copied example; one that a single
repository of a single owner holds, and that looks random, is a live-looking credential of that owner. Spans of kind ``live`` mark the values of
the latter and stand beside the base spans, which all stay. What lies between is shared: too common to be called live, too rare for an
example. It is treated as a secret; its values of the two added kinds, which no base span shows, get spans of kind ``shared``
if they look random.

``documents`` names no owner: a source counts as an owner and each of its languages as a repository;
both are parameters.

Positions. Spark returns matched strings, not places. Each match is therefore taken together with the
text since the match before (anchored there, so the search stays linear), and places are
running sums of lengths, in code points. Texts without any match skip this.

Scale. Only candidates (hash, row, place) are shuffled, never texts. Values are counted by partial
aggregates on (hash, owner, repository), so a value that a third of all rows hold is one row per
task; the join back to rows is on the hash, where Spark may split a hot value.

Defined results: null text is empty; null owners and repositories count as one empty name; an empty table
gives an empty result; rows that repeat are scanned each and count once for their owner; input
columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, whole_text

EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 4
REDACTED = "<secret>"
# Kind -> (pattern, group of the value, condition on the value). The first three are the base kinds, as given.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", _ASSIGN, 1, lambda v: F.length(v) >= 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, None),
    ("hex", r"[0-9a-f]{24,}", 0, None),
    ("prefixed", r"(?<![A-Za-z0-9_-])(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|ya29\.)[A-Za-z0-9_-]{16,}", 0, None),
    ("random", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])", 0,
     lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")),
)
BASE = 3
SPAN = "array<struct<start:int,kind:int,end:int,value_at:int,hash:string,random:boolean>>"


def _spans(text: Column, kind: int) -> Column:
    _, pattern, group, condition = KINDS[kind]
    pieces = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))

    def step(acc: Column, piece: Column) -> Column:
        match = F.regexp_extract(piece, pattern, 0)
        value = F.regexp_extract(piece, pattern, group)
        end = acc["at"] + F.length(piece)
        span = F.struct((end - F.length(match)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                        (end - F.length(value)).alias("value_at"), F.sha2(value, 256).alias("hash"), _random(value).alias("random"))
        good = F.lit(True) if condition is None else condition(value)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def _random(value: Column) -> Column:
    """Eight different characters or more, a digit among them."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 8) & value.rlike("[0-9]")


def marked(docs: DataFrame, keep: list[str], owner: list[str], repository: list[str]) -> DataFrame:
    """``keep`` columns with ``_spans`` (all kinds, by start), ``_owner``, ``_repo`` and ``_row``, written once."""
    def name(cols: list[str]) -> Column:
        return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])

    keep = [c for c in keep if c.lower() not in ("_spans", "_owner", "_repo", "_row")]
    text = whole_text()
    rows = docs.select(*keep, name(owner).alias("_owner"), name(repository).alias("_repo"),
                       F.array_sort(F.concat(*[_spans(text, k) for k in range(len(KINDS))])).alias("_spans"))
    return materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "secret-spans")


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, owners, repositories): by how many distinct ones each candidate value is held."""
    return rows.select("_owner", "_repo", F.explode("_spans").alias("s")) \
        .groupBy(F.col("s.hash").alias("hash"), "_owner", "_repo").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def judged(rows: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Per row with candidates: ``_live``, ``_shared`` and ``_redact``, arrays of (start, end) of values."""
    cands = rows.select("_row", F.explode("_spans").alias("s")).select("_row", "s.*")
    held = cands.join(ownership(rows), "hash")
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    single = (F.col("owners") == 1) & (F.col("repositories") == 1)
    live = ~example & single & F.col("random")
    shared = ~example & ~single & F.col("random") & (F.col("kind") >= BASE)
    secret = ~example & ((F.col("kind") < BASE) | live | shared)
    place = F.struct(F.col("value_at").alias("start"), "end")
    return held.groupBy("_row").agg(F.array_sort(F.collect_set(F.when(live, place))).alias("_live"),
                                    F.array_sort(F.collect_set(F.when(shared, place))).alias("_shared"),
                                    F.array_sort(F.collect_set(F.when(secret, place))).alias("_redact"))


def find_secrets(docs: DataFrame, keep: list[str] | None = None, owner: list[str] = ("source",),
                 repository: list[str] = ("source", "lang")) -> DataFrame:
    """``keep`` columns (all by default) with n_assign, n_access, n_hex, base_sha256 and spans."""
    made = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    rows = marked(docs, keep, list(owner), list(repository))
    base = F.filter("_spans", lambda s: s["kind"] < BASE)
    names = F.array(*[F.lit(k[0]) for k in KINDS])

    def written(s: Column) -> Column:
        return F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])

    none = F.array().cast("array<struct<start:int,end:int>>")

    def judged_spans(verdict: str, kind: int) -> Column:
        return F.transform(F.coalesce(f"_{verdict}", none), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"),
                                                                               F.concat_ws(":", F.lit(verdict), s["start"], s["end"]).alias("text")))

    live, shared = judged_spans("live", len(KINDS)), judged_spans("shared", len(KINDS) + 1)
    shown = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), written(s).alias("text")))
    out = rows.join(judged(rows), "_row", "left")
    kinds = F.transform("_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k][0]}") for k in range(BASE)]
    return out.select(*keep, *counts, F.sha2(F.concat_ws(",", F.transform(base, written)), 256).alias("base_sha256"),
                      F.concat_ws(",", F.transform(F.array_sort(F.concat(shown, live, shared)), lambda s: s["text"])).alias("spans"))


def redacted(docs: DataFrame, owner: list[str] = ("source",), repository: list[str] = ("source", "lang")) -> DataFrame:
    """The documents with the values of secrets replaced; widely copied examples and other columns stay as they are."""
    names = {c.lower() for c in docs.columns}
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), *dict.fromkeys(["text", *owner, *repository]))
    rows = marked(whole, ["_doc"], list(owner), list(repository))
    out = rows.join(judged(rows), "_row", "left").withColumn("text", F.col("_doc.text"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring("text", acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(REDACTED)).alias("out"))) \
            .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_redact", start, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    out = out.withColumn("_clean", F.when(F.size("_redact") > 0, clean))
    changed = F.col("_doc").withField("text", F.col("_clean"))
    if "n_chars" in names:
        changed = changed.withField("n_chars", F.length("_clean").cast(docs.schema["n_chars"].dataType))
    return out.select(F.when(F.col("_clean").isNotNull(), changed).otherwise(F.col("_doc")).alias("_doc")).select("_doc.*")


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir), keep=["doc_id"])


QUERIES = {"op3_secret_ownership": op3_secret_ownership}
ORACLES: dict[str, str] = {}
