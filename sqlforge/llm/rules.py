"""Quality classifier by a sparse ensemble of rules (operator 11).

Each text has a row of statistics (``STATISTICS``). Small regression trees, boosted so that each one
fits what the ones before it left, are grown on them; every path from a root to a node is a rule, a
conjunction of thresholds. A logistic model over the 0/1 columns of all rules is then fitted with a lasso penalty, which
leaves most rules without weight. The rest is compiled into one Spark column expression over the statistics:
``1 / (1 + exp(-(bias + sum of the weights of the rules that hold)))``.

The model is fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled documents of each class, those with the smallest
hash of their id, whole texts. Only their statistics, ``8 * len(STATISTICS)`` bytes a document, meet in the one task that
grows the trees. What it gives, at most ``TREES * 2 * (2 ** DEPTH - 1)`` rules, is a property of the plan and not of the data.
The classes weigh as in all labelled documents, so that the score is the share of label 1 among the like of a document.

All documents are scored in one pass without a shuffle: Arrow batches give the statistics, the rules are evaluated by Spark.

Defined results: null and empty texts have the statistics of a text without words (all 0); without labelled rows of
both classes every score is the smoothed share of label 1; labels that disagree on an id count as
0; repeated rows are scored each; a null doc_id isn't learned from and counts as empty text in the held-out rule; other columns
stay as they are (``score`` and ``predicted`` are replaced); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, read_table, sized, whole_text

SAMPLE_ROWS = 4000       # labelled documents per class that the model is fitted on
FOLDS, HELD_OUT = 4, 2   # labels of documents with crc32(id) mod 4 = 2 are held out
KEEP = 0.7               # least score of a document that is predicted good
TREES = 40
DEPTH = 3
LEAF_ROWS = 20           # rows that a node holds at least
CUTS = 48                # thresholds tried for a statistic: quantiles of the sample
STEP = 0.3               # share of a tree's fit that the next trees see as done
SHARE = 0.6              # share of the rows that a tree is grown on
PENALTY = 0.002          # lasso weight, for a loss that is a mean over rows
ROUNDS = 400             # proximal gradient steps

STATISTICS = ("log_words", "word_length", "symbols", "marks", "digits", "capitals", "variety", "top_word", "repeated_lines",
              "repeated_triples", "bare_words", "line_words", "ended_lines", "non_ascii", "long_words", "pipes")
_SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"
_DIGITS = b"0123456789"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123)) + bytes(range(128, 256))
_WHITE = b" \t\n\r\x0b\x0c"
_MARKS = bytes(b for b in range(256) if b not in _LETTERS + _WHITE)
_LEADING = bytes(range(0xC3, 0xF5))      # first bytes of the UTF-8 of characters from U+00C0 on


def _number(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def statistics_of(text: str | None) -> list[float]:
    """The statistics of a text, in the order of ``STATISTICS``; shares are of its bytes, words or lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = sum(map(len, words))
    seen = Counter(words)
    lines = [x for x in (y.strip(_WHITE) for y in raw.split(b"\n")) if x]
    letters, digits, symbols = _number(raw, _LETTERS), _number(raw, _DIGITS), _number(raw, _SYMBOLS)
    triples = max(0, n - 2)
    different = len(set(zip(words, words[1:], words[2:])))
    return [math.log(n), size / n, symbols / size, (size - letters - digits - symbols) / size, digits / size,
            _number(raw, _CAPITALS) / max(1, letters), math.log(1 + len(seen)) / math.log(1 + n), max(seen.values()) / n,
            1 - len(set(lines)) / len(lines), 1 - different / triples if triples else 0.0,
            1 - len(raw.translate(None, _MARKS).split()) / n, math.log(1 + n / len(lines)),
            sum(x[-1:] in b".!?:;\"'" for x in lines) / len(lines), _number(raw, _LEADING) / size,
            sum(c for w, c in seen.items() if len(w) > 20) / n, seen.get(b"|", 0) / n]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the statistics of its text, as columns named ``_s0``, ``_s1``, ... in their order."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            s = np.array([statistics_of(t) for t in b.column("_text").to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(b.column(f"_k{k}") for k in range(len(keep))), *(pa.array(s[:, j]) for j in range(len(STATISTICS)))],
                                             names=[f"_k{k}" for k in range(len(keep))] + [f"_s{j}" for j in range(len(STATISTICS))])

    rows = docs.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(keep)), F.col("text").cast("string").alias("_text"))
    kind = rows.drop("_text").withColumns({f"_s{j}": F.lit(0.0) for j in range(len(STATISTICS))}).schema
    return rows.mapInArrow(run, kind)


# ------------------------------------------------------------------ trees and their paths
Rule = tuple[tuple[int, bool, float], ...]      # (statistic, above?, threshold), all of which hold


def grow(x: np.ndarray, cuts: list[np.ndarray], left: np.ndarray, rows: np.ndarray, path: Rule = (), depth: int = DEPTH) -> tuple[list[Rule], list]:
    """Paths of a regression tree to what is left, and its leaves (rows, mean)."""
    best = None
    if depth and len(rows) >= 2 * LEAF_ROWS:
        r = left[rows]
        total, n = r.sum(), len(rows)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            at = np.searchsorted(c, x[rows, j], side="left")      # x <= c[k] for k >= at
            under = np.cumsum(np.bincount(at, minlength=len(c) + 1))[:-1]
            part = np.cumsum(np.bincount(at, weights=r, minlength=len(c) + 1))[:-1]
            ok = (under >= LEAF_ROWS) & (n - under >= LEAF_ROWS)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, part ** 2 / under + (total - part) ** 2 / (n - under), -np.inf)
            k = int(np.argmax(gain))
            if best is None or gain[k] > best[0] + 1e-12:
                best = (gain[k], j, float(c[k]))
        if best is not None and best[0] - total ** 2 / n < 1e-9:
            best = None
    if best is None:
        return [], [(path, float(left[rows].mean()) if len(rows) else 0.0)]
    _, j, cut = best
    rules, leaves = [], []
    for above in (False, True):
        p = simplify(path + ((j, above, cut),))
        side = rows[(x[rows, j] > cut) == above]
        rules.append(p)
        more, ends = grow(x, cuts, left, side, p, depth - 1)
        rules += more
        leaves += ends
    return rules, leaves


def simplify(path: Rule) -> Rule:
    """A path with one lower and one upper threshold a statistic at most, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for j, above, cut in path:
        old = tight.get((j, above))
        tight[j, above] = cut if old is None else max(old, cut) if above else min(old, cut)
    return tuple((j, above, cut) for (j, above), cut in sorted(tight.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), np.bool_)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def paths(x: np.ndarray, y: np.ndarray, seed: int = 11) -> list[Rule]:
    """The different rules of all trees."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1], method="inverted_cdf")) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    odds, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        left = y - 1 / (1 + np.exp(-odds))
        rows = np.sort(rng.permutation(len(y))[:max(1, int(SHARE * len(y)))])
        some = rng.random(x.shape[1]) < SHARE
        found, leaves = grow(x, [c if s else c[:0] for c, s in zip(cuts, some)], left, rows)
        rules.update(dict.fromkeys(found))
        for path, value in leaves:
            odds += STEP * 4 * value * holds(path, x)
    return list(rules)


# ------------------------------------------------------------------ lasso
def lasso(z: np.ndarray, y: np.ndarray, weigh: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model that minimises weighted mean loss + penalty * sum |weights| (accelerated proximal gradient)."""
    weigh = weigh / weigh.sum()
    z1 = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    v = np.ones(z1.shape[1])
    for _ in range(30):           # largest eigenvalue of the curvature's bound
        v = z1.T @ (weigh * (z1 @ (v / np.linalg.norm(v))))
    rate = 1 / (0.25 * np.linalg.norm(v) * 1.05 + 1e-12)
    beta = ahead = np.zeros(z1.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z1 @ ahead, -60, 60)))
        new = ahead - rate * (z1.T @ (weigh * (p - y)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - rate * penalty)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        beta, ahead = new, new + (last - 1) / t * (new - beta)
    return beta[:-1], float(beta[-1])


class Model:
    """Rules with their weights, and a bias: log odds of label 1."""

    def __init__(self, rules: list[Rule], weights: list[float], bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights):
            odds += w * holds(rule, x)
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def column(self) -> Column:
        """The score as an expression over the columns of the statistics."""
        odds = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            cond = F.lit(True)
            for j, above, cut in rule:
                s = F.col(f"_s{j}")
                cond = cond & ((s > cut) if above else (s <= cut))
            odds = odds + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-60.0)), F.lit(60.0))))

    def describe(self) -> list[str]:
        """The rules in words, strongest first."""
        text = [" and ".join(f"{STATISTICS[j]} {'>' if above else '<='} {cut:.4g}" for j, above, cut in rule) for rule in self.rules]
        return [f"{w:+.3f} if {t}" for w, t in sorted(zip(self.weights, text), key=lambda p: -abs(p[0]))]


def train(x: np.ndarray, y: np.ndarray, share: float | None = None, seed: int = 11) -> Model:
    """Model from statistics and labels; ``share`` is that of label 1 among all labelled documents."""
    if len(set(y.tolist())) < 2:
        return Model([], [], float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rules = paths(x, y, seed)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    share = float(y.mean()) if share is None else share
    weigh = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, bias = lasso(z, y, weigh)
    kept = np.flatnonzero(np.abs(w) > 1e-9)
    return Model([rules[k] for k in kept], [float(w[k]) for k in kept], bias)


# ------------------------------------------------------------------ on Spark
def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 11) -> Model:
    """Model from the labelled documents that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()) \
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("_y"))
    first = [known.filter(F.col("_y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    counts = known.groupBy("_y").count()
    ids = sized(first[0].unionByName(first[1]).join(F.broadcast(counts), "_y").withColumnRenamed("count", "_all"), "rules-sample")
    one = docs.select("doc_id", whole_text().alias("text")).join(ids, "doc_id")
    # Statistics are made where the documents lie; only they meet in one task. Of rows with one id the least statistics count.
    stats = with_statistics(one, ["doc_id", "_y", "_all"])
    vec = F.array(*(f"_s{j}" for j in range(len(STATISTICS))))
    sample = stats.groupBy(F.col("_k0").alias("doc_id"), F.col("_k1").alias("y"), F.col("_k2").alias("n")).agg(F.min(vec).alias("v"))

    def run(batches):
        import pyarrow as pa
        got = sorted((i, y, n, v) for b in batches for i, y, n, v in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "n", "v"))))
        if not got:
            return
        y = np.array([g[1] for g in got], np.float64)
        per = {g[1]: g[2] for g in got}
        m = train(np.array([g[3] for g in got]), y, per.get(1, 0) / sum(per.values()), seed)
        yield pa.RecordBatch.from_pydict({
            "rules": pa.array([[[{"j": j, "above": a, "cut": c} for j, a, c in r] for r in m.rules]],
                              pa.list_(pa.list_(pa.struct([("j", pa.int32()), ("above", pa.bool_()), ("cut", pa.float64())])))),
            "weights": pa.array([m.weights], pa.list_(pa.float64())), "bias": [m.bias]})

    model = materialize(sample.repartition(1).mapInArrow(
        run, "rules array<array<struct<j:int,above:boolean,cut:double>>>, weights array<double>, bias double"), "rules-model").first()
    if model is None:
        return Model([], [], 0.0)
    return Model([tuple((c["j"], c["above"], c["cut"]) for c in r) for r in model["rules"]], list(model["weights"]), model["bias"])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with score and predicted."""
    cols = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    value = with_statistics(docs, cols).select(*(F.col(f"_k{k}").alias(c) for k, c in enumerate(cols)), model.column().alias("score"))
    return value.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def op11_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op11_rule_quality": op11_rule_quality}
ORACLES: dict[str, str] = {}
