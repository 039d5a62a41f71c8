"""Quality rules by robust multivariate outliers (operator 5).

Each text has a few counts and, from them, a vector of transformed statistics. For every language and source the
minimum-covariance-determinant estimate of centre and scatter is fitted to the vectors of the
documents that pass the base rules, and a document is rejected if its squared Mahalanobis distance passes the
0.999 quantile of its group's distances, extrapolated from their median and upper quartile (``cut_off``).

The fit covers all documents. It starts from two estimates (mean and covariance; median and quartile
range) and repeats concentration steps: the distances to the last estimate, their histogram in bins of an eighth
of an octave, the least bin edge below which ``SUPPORT`` of the group lies, and the mean and
covariance of those. The best estimate is then taken again from all documents within the 0.999 quantile. A step is one pass that gives, per bin, a count, sums and sums of products, so a group of any
size adds up from partial sums and nothing is gathered. The estimate with the smaller determinant wins.
A statistic that is constant for most documents (no symbols at all) would make the scatter
singular; ``FLOORS`` are the least standard deviations in such directions, and change nothing where the group spreads more.

Every group with a document that passes the base rules has a fit of its own, whatever its size. A few documents don't
fix a scatter, so each step's estimate of a group of n documents is ``n / (n + SHRINK)`` its own and for
the rest that of its language, which is fitted first by the same steps (a minimum regularized covariance determinant with the
language as its target). The share has no threshold in n, and no group sees another language's documents.

Vectors lie in blocks of about ``BLOCK_ROWS`` documents of a group, which deals a hot source out evenly.

Defined results: null and empty texts have no words and fail the base rules; null languages and
sources are a name of their own; rows that repeat are judged each; an empty table gives an empty result;
other columns are not read. Documents that fail the base rules are not fitted, and not kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
LETTERS = re.compile(r"[^\W\d_]+")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
# Statistic -> least standard deviation. All but the first two are shares.
FLOORS = {"word_length": 0.005, "variety": 0.002, "symbols": 0.006, "repeated_lines": 0.04, "repeated_words": 0.04,
          "digits": 0.02, "capitals": 0.001, "other_marks": 0.001}
DIM = len(FLOORS)
SUPPORT = 0.75
STEPS = 6
TAIL_Z = 3.0902          # the 0.999 quantile
UPPER_Z = 0.6745         # the upper quartile
BLOCK_ROWS = 512
SHRINK = 100             # a group of so many documents counts half, its language the other half
SKETCH = 500             # accuracy of the quartiles that one start begins with
BINS_PER_OCTAVE = 8
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi_square(z: float, p: int = DIM) -> float:
    """Quantile of chi-square with p degrees of freedom at a standard normal deviate (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def counts(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, different words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()     # bytes: ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen, inside = Counter(windows), bytearray(n)
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    inside[i] = inside[i + 1] = inside[i + 2] = 1
            repeated = sum(inside)
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), len(set(words))


def vector(text: str | None, c: tuple) -> list[float]:
    """Transformed statistics of a text, in the order of ``FLOORS``."""
    n, chars, symbols, dup, repeated, lines, different = c
    if not n:
        return [0.0] * DIM
    text = text or ""
    letters = sum(map(len, LETTERS.findall(text)))
    digits = sum(map(text.count, "0123456789"))
    capitals = len(CAPITALS.findall(text))
    return [math.log(chars / n), math.log(different) / math.log(n) if n > 1 else 1.0, symbols / chars, dup / lines,
            repeated / n, digits / chars, capitals / chars, max(0, chars - letters - digits - symbols) / chars]


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and vec (doubles as bytes) of each document."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            found = [(c := counts(t), np.array(vector(t, c)).tobytes()) for t in b.column("text").to_pylist()]
            cols = [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(COUNTS))]
            bad = pa.array([bool(base_failed(c[0], c[4])) for c, _ in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *cols, bad, pa.array([v for _, v in found], pa.binary())],
                                             names=["doc_id", "lang", "source", *COUNTS, "base_failed", "vec"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, vec binary")


def blocks(stats: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of a group in blocks: g (group), over (its language), part and lists of all columns."""
    def name(*cols):
        return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})

    sizes = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n"))
    sizes = materialize(sizes.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), name("lang", "source").alias("g"), name("lang").alias("over"),
                                     F.ceil(F.col("_n") / block_rows).cast("int").alias("_parts")).coalesce(1), "quality-groups")
    keyed = stats.join(sizes, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))) \
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "vec", *COUNTS), F.col("_parts"))) \
        .select("g", "over", "part", "doc_id", *COUNTS, "base_failed", "vec")

    def gather(key, table):
        import pyarrow as pa
        cols = {c: [table.column(c).to_pylist()] for c in ("doc_id", *COUNTS, "base_failed")}
        vec = b"".join(table.column("vec").to_pylist())
        return pa.table({"g": [key[0].as_py()], "over": [key[1].as_py()], "vec": pa.array([vec], pa.binary())} |
                        {c: pa.array(v, pa.list_(pa.bool_() if c == "base_failed" else pa.int64())) for c, v in cols.items()})

    lists = ", ".join(f"{c} array<bigint>" for c in ("doc_id", *COUNTS))
    return keyed.groupBy("g", "over", "part").applyInArrow(gather, f"g string, over string, vec binary, {lists}, base_failed array<boolean>")


def _decode(mean: bytes, scatter: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(mean), np.frombuffer(scatter).reshape(DIM, DIM)


def distances(x: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances."""
    y = np.linalg.solve(np.linalg.cholesky(scatter), (x - mean).T)
    return (y * y).sum(axis=0)


def bins(d2: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(d2, 2.0 ** -10)) * BINS_PER_OCTAVE).astype(np.int64)


def bin_edge(b) -> float:
    return 2.0 ** (b / BINS_PER_OCTAVE)


def estimate(n: float, sums: np.ndarray, prods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance, the latter raised to the least standard deviations where it has less."""
    mean = sums / n
    cov = np.zeros((DIM, DIM))
    for (i, j), v in zip(PAIRS, prods / n):
        cov[i, j] = cov[j, i] = v - mean[i] * mean[j]
    return mean, raised(cov)


def raised(cov: np.ndarray) -> np.ndarray:
    """A covariance with no less variance in any direction than ``FLOORS`` have."""
    floors = np.array(list(FLOORS.values()))
    unit = np.outer(floors, floors)
    size, direction = np.linalg.eigh(cov / unit)
    return cov if size[0] >= 1 else (direction * np.maximum(size, 1.0)) @ direction.T * unit


def quantile(bin_no: np.ndarray, count: np.ndarray, share: float) -> float:
    """Quantile of distances from their histogram (bins ascending), evenly spread on the log scale inside a bin."""
    upto = np.cumsum(count)
    k = int(np.searchsorted(upto, share * upto[-1] - 1e-9))
    inside = (share * upto[-1] - (upto[k] - count[k])) / count[k]
    return bin_edge(bin_no[k] - 1 + min(max(inside, 0.0), 1.0))


def scale(median: float, upper: float) -> float:
    """By how much distances exceed chi-square in their lower three quarters, 1 at least."""
    return max(1.0, median / chi_square(0.0), upper / chi_square(UPPER_Z))


def cut_off(median: float, upper: float, tail_z: float = TAIL_Z) -> float:
    """Distance of the upper tail: the step from the median to the upper quartile carried on, on the log scale, as
    chi-square's goes on; chi-square's own quantile at least.

    It rests on the nearer three quarters of the documents. The step is at most that of one degree of freedom, so that a
    group that is half copies of one text has a finite cut-off.
    """
    step = min(math.log(upper / median), math.log(chi_square(UPPER_Z, 1) / chi_square(0.0, 1)))
    further = math.log(chi_square(tail_z) / chi_square(UPPER_Z)) / math.log(chi_square(UPPER_Z) / chi_square(0.0))
    return max(chi_square(tail_z), upper * math.exp(step * further))


def _partial_sums(held: DataFrame, fits: DataFrame | None, starts: int = 2) -> DataFrame:
    """Per group, start and distance bin: n, sums and products, as columns v0, v1, ..."""
    names = [f"v{k}" for k in range(1 + DIM + len(PAIRS))]
    starts = 0 if fits is None else starts

    def run(batches):
        import pyarrow as pa
        total: dict = {}

        def out():
            keys = list(total)
            vals = np.array([total[k] for k in keys]).reshape(len(keys), len(names))
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                               pa.array([k[2] for k in keys], pa.int64()), *(pa.array(vals[:, i]) for i in range(len(names)))],
                                              names=["g", "start", "bin", *names])
        for b in batches:
            for row in b.to_pylist():
                x = np.frombuffer(row["vec"]).reshape(-1, DIM)[~np.array(row["base_failed"], dtype=bool)]
                if not len(x):
                    continue
                full = np.concatenate([np.ones((len(x), 1)), x, np.stack([x[:, i] * x[:, j] for i, j in PAIRS], axis=1)], axis=1)
                for start in range(max(1, starts)):
                    at = bins(distances(x, *_decode(row[f"mean{start}"], row[f"scatter{start}"]))) if starts else np.zeros(len(x), np.int64)
                    for k in np.unique(at).tolist():
                        part = full[at == k].sum(axis=0)
                        key = (row["g"], start, k)
                        total[key] = total[key] + part if key in total else part
            if len(total) > 50_000:
                yield out()
        if total:
            yield out()

    rows = held.select("g", "vec", "base_failed")
    rows = rows if fits is None else rows.join(fits, "g")
    return rows.mapInArrow(run, "g string, start int, bin long, " + ", ".join(f"{n} double" for n in names)) \
        .groupBy("g", "start", "bin").agg(*[F.sum(n).alias(n) for n in names])


FITS = "g string, mean0 binary, scatter0 binary, mean1 binary, scatter1 binary"


def _shrunk(df: pd.DataFrame, n: float, mean: np.ndarray, scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An estimate from a group of n documents, drawn towards the target that stands beside its sums, if any."""
    if "t_mean" not in df:
        return mean, scatter
    own, (t_mean, t_scatter) = n / (n + SHRINK), _decode(df["t_mean"].iloc[0], df["t_scatter"].iloc[0])
    return own * mean + (1 - own) * t_mean, own * scatter + (1 - own) * t_scatter


def targets(held: DataFrame, fits: DataFrame) -> DataFrame:
    """The language's estimate beside each group: g, t_mean, t_scatter."""
    named = fits.select(F.col("g").alias("over"), *[F.col(c).alias(f"t_{c}") for c in fits.columns if c != "g"])
    return materialize(held.select("g", "over").distinct().join(named, "over").drop("over").coalesce(1), "quality-targets")


def _beside(sums: DataFrame, towards: DataFrame | None) -> DataFrame:
    return sums if towards is None else sums.join(towards, "g")


def first_fits(held: DataFrame, stats_g: DataFrame, towards: DataFrame | None = None) -> DataFrame:
    """Start 0: mean and covariance. Start 1: median and quartile range."""
    sums = _partial_sums(held, None)
    quart = stats_g.groupBy("g").agg(*[F.percentile_approx(f"x{k}", [0.25, 0.5, 0.75], SKETCH).alias(f"q{k}") for k in range(DIM)])

    def run(df: pd.DataFrame) -> pd.DataFrame:
        v = df[[c for c in df.columns if re.fullmatch(r"v\d+", c)]].sum().to_numpy()
        mean, scatter = estimate(v[0], v[1:1 + DIM], v[1 + DIM:])
        q = np.array([df[f"q{k}"].iloc[0] for k in range(DIM)], dtype=float)
        wide = raised(np.diag(np.square((q[:, 2] - q[:, 0]) / 1.349)))
        starts = [x.tobytes() for m, s in ((mean, scatter), (q[:, 1], wide)) for x in _shrunk(df, v[0], m, s)]
        return pd.DataFrame([[df["g"].iloc[0], *starts]], columns=[x.split()[0] for x in FITS.split(", ")])

    return _beside(sums.join(quart, "g"), towards).groupBy("g").applyInPandas(run, FITS)


def concentrate(held: DataFrame, fits: DataFrame, towards: DataFrame | None = None, support: float = SUPPORT) -> DataFrame:
    """One concentration step for both starts of every group."""
    def run(df: pd.DataFrame) -> pd.DataFrame:
        row = {"g": df["g"].iloc[0]}
        for start in (0, 1):
            own = df[df["start"] == start].sort_values("bin")
            v = own[[c for c in own.columns if re.fullmatch(r"v\d+", c)]].to_numpy()
            upto = np.cumsum(v[:, 0])
            k = int(np.searchsorted(upto, support * upto[-1] - 1e-9))
            v_in = v[:k + 1].sum(axis=0)
            mean, scatter = _shrunk(df, upto[-1], *estimate(v_in[0], v_in[1:1 + DIM], v_in[1 + DIM:]))
            row |= {f"mean{start}": mean.tobytes(), f"scatter{start}": scatter.tobytes()}
        return pd.DataFrame([row])[[x.split()[0] for x in FITS.split(", ")]]

    return _beside(_partial_sums(held, fits), towards).groupBy("g").applyInPandas(run, FITS)


def fit(held: DataFrame, steps: int = STEPS, towards: DataFrame | None = None) -> DataFrame:
    """(g, mean, scatter): the estimate with the smaller determinant."""
    spread = held.select("g", F.explode(_rows_of("vec", "base_failed")).alias("x")).select("g", *[F.col("x")[k].alias(f"x{k}") for k in range(DIM)])
    fits = materialize(first_fits(held, spread, towards), "quality-fits")
    for _ in range(steps):
        fits = materialize(concentrate(held, fits, towards), "quality-fits")

    def best(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for r in b.to_pylist():
                fitted = [_decode(r[f"mean{s}"], r[f"scatter{s}"]) for s in (0, 1)]
                s = int(np.linalg.slogdet(fitted[1][1])[1] < np.linalg.slogdet(fitted[0][1])[1])
                out.append((r["g"], fitted[s][0].tobytes(), fitted[s][1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *(pa.array([o[k] for o in out], pa.binary()) for k in (1, 2))],
                                             names=["g", "mean", "scatter"])

    return materialize(fits.mapInArrow(best, "g string, mean binary, scatter binary"), "quality-best")


def reweighted(held: DataFrame, best: DataFrame, towards: DataFrame | None = None) -> DataFrame:
    """(g, mean, scatter, scale, cut): the estimate from all documents within the 0.999 quantile of ``best``, and its cut-off."""
    def first(fits):
        return fits.select("g", F.col("mean").alias("mean0"), F.col("scatter").alias("scatter0"))

    def histogram(df):
        own = df.sort_values("bin")
        at, v = own["bin"].to_numpy(), own[[c for c in own.columns if re.fullmatch(r"v\d+", c)]].to_numpy()
        return at, v, quantile(at, v[:, 0], 0.5), quantile(at, v[:, 0], 0.75)

    def own_share(df, n):
        return n / (n + SHRINK) if "t_mean" in df else 1.0

    def again(df: pd.DataFrame) -> pd.DataFrame:
        at, v, median, upper = histogram(df)
        n, wide = v[:, 0].sum(), scale(median, upper)
        own = own_share(df, n)
        wide = wide if own == 1.0 else own * wide + (1 - own) * df["t_scale"].iloc[0]
        near = v[bin_edge(at) <= wide * chi_square(TAIL_Z)].sum(axis=0)
        if near[0]:
            mean, scatter = _shrunk(df, n, *estimate(near[0], near[1:1 + DIM], near[1 + DIM:]))
        else:              # few documents, all far from their language
            mean, scatter = _decode(df["t_mean"].iloc[0], df["t_scatter"].iloc[0])
        return pd.DataFrame({"g": [df["g"].iloc[0]], "mean": [mean.tobytes()], "scatter": [scatter.tobytes()]})

    def calibrate(df: pd.DataFrame) -> pd.DataFrame:
        _, v, median, upper = histogram(df)
        own, wide, cut = own_share(df, v[:, 0].sum()), scale(median, upper), cut_off(median, upper)
        if own < 1.0:
            wide = own * wide + (1 - own) * df["t_scale"].iloc[0]
            cut = math.exp(own * math.log(cut) + (1 - own) * math.log(df["t_cut"].iloc[0]))
        return pd.DataFrame({"g": [df["g"].iloc[0]], "scale": [wide], "cut": [cut]})

    fits = _beside(_partial_sums(held, first(best), 1), towards).groupBy("g").applyInPandas(again, "g string, mean binary, scatter binary")
    fits = materialize(fits, "quality-fits")
    tails = _beside(_partial_sums(held, first(fits), 1), towards).groupBy("g").applyInPandas(calibrate, "g string, scale double, cut double")
    return materialize(fits.join(tails, "g"), "quality-best")


def _rows_of(vec: str, failed: str):
    @F.pandas_udf("array<array<double>>")
    def rows(v: pd.Series, bad: pd.Series) -> pd.Series:
        return pd.Series([[x.tolist() for x in np.frombuffer(a).reshape(-1, DIM)[~np.array(b, dtype=bool)]] for a, b in zip(v, bad)])
    return rows(F.col(vec), F.col(failed))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and distance (squared; null where nothing was fitted) of each document."""
    held = materialize(blocks(materialize(statistics(docs), "quality-stats")), "quality-blocks")
    of_language = held.withColumn("g", F.col("over"))
    languages = fit(of_language)
    best = reweighted(held, fit(held, towards=targets(held, languages)), targets(held, reweighted(of_language, languages)))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for r in b.to_pylist():
                bad = np.array(r["base_failed"], dtype=bool)
                d2 = np.full(len(bad), np.nan)
                if r["mean"] is not None:
                    d2 = distances(np.frombuffer(r["vec"]).reshape(-1, DIM), *_decode(r["mean"], r["scatter"]))
                yield pa.RecordBatch.from_arrays([*(pa.array(r[c], pa.int64()) for c in ("doc_id", *COUNTS)), pa.array(bad),
                                                  pa.array(~bad & ~(d2 > (r["cut"] or 0))), pa.array(d2, from_pandas=True)],
                                                 names=["doc_id", *COUNTS, "base_failed", "kept", "distance"])

    return held.join(best, "g", "left").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, distance double")


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", *COUNTS, "base_failed", "kept")


QUERIES = {"op5_robust_outliers": op5_robust_outliers}
ORACLES: dict[str, str] = {}
