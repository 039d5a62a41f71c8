"""Toxicity by subword-bag embeddings averaged into a linear softmax (operator 6).

A word is the bag of its character 3- to 5-grams (with marks at its ends) and itself, each hashed to one of
``BUCKETS`` embedding rows. A document is the average of the embeddings of the units of its different words (a line said a
hundred times is said once); a linear softmax on it gives the score. Embeddings and softmax are trained jointly in numpy, so a
misspelling that was never seen shares the vectors of the n-grams it kept.

The model is fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled documents of each class,
those with the smallest hash of their id, whole texts. Bags are made where the texts lie, units that fewer than ``SEEN`` of them
hold are counted and left out there, and one task trains on what is left, 6 bytes a unit; the scoring form is one
number per bucket (the embedding row times the difference of the softmax columns), 4 * BUCKETS bytes,
which goes to the tasks that score all documents in one pass without a shuffle.

Defined results: null and empty texts are scored by the bias alone; without labelled rows of both
classes every score is the smoothed share of label 1; labels that disagree on an id count as
1; repeated rows are scored each; a null doc_id counts as empty text in the held-out rule.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, read_table, release_caches, sized, whole_text

BUCKETS = 1 << 18
DIM = 4
GRAMS = (3, 4, 5)
SAMPLE_ROWS = 4000       # labelled documents per class that the model is fitted on
EPOCHS = 8
STEPS = 150              # mini-batches at least, however few documents are labelled
SEEN = 3                 # units in fewer documents of the sample keep the weight 0
REST = 200               # units without weight that every text holds besides its own: short texts lean to the bias
BATCH = 64
RATE = 2.0
FOLDS = 5                # labels of documents with crc32(id) mod 5 = 0 are held out
CACHE_WORDS = 200_000    # words kept by a task; later ones are looked up each time
LONG_WORD = 200          # longer words are cut into stretches of this length
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def units(word: str) -> list[int]:
    """Bucket of the word and of each of its n-grams."""
    word = EDGE.sub("", word)
    if not word:
        return []
    if len(word) > LONG_WORD:
        return [u for k in range(0, len(word), LONG_WORD) for u in units(word[k:k + LONG_WORD])]
    marked = f"<{word}>"
    found = [marked] + [marked[k:k + n] for n in GRAMS for k in range(len(marked) - n + 1) if n < len(marked)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in found]


def bag(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct units of a text, how often each occurs (65,535 at most), and how many units there are."""
    got: Counter = Counter()
    for word in set(text.lower().split()):
        got.update(units(word))
    index = np.fromiter(got, dtype=np.int32, count=len(got))
    count = np.fromiter(got.values(), dtype=np.int64, count=len(got))
    return index, np.minimum(count, 65_535).astype(np.uint16), int(count.sum())


class Model:
    """weight: one number per bucket; the log odds of a text are bias plus the mean weight of its units."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias, self.words = weight, bias, {}

    def word(self, word: str) -> tuple[float, int]:
        found = self.words.get(word)
        if found is None:
            u = units(word)
            found = (float(self.weight[u].sum()) if u else 0.0, len(u))
            if len(word) <= LONG_WORD and len(self.words) < CACHE_WORDS:
                self.words[word] = found
        return found

    def score(self, text: str) -> float:
        total, n = 0.0, 0
        for word in set(text.lower().split()):
            value, many = self.word(word)
            total += value
            n += many
        odds = self.bias + total / (n + REST)
        return float(1.0 / (1.0 + np.exp(-np.clip(odds, -60, 60))))


class Bags:
    """Bags of many texts in three flat arrays: those of text r are index[start[r]:start[r + 1]] with their counts, of ``total[r]`` units."""

    def __init__(self, start: np.ndarray, index: np.ndarray, count: np.ndarray, total: np.ndarray):
        self.start, self.index, self.count, self.total = start, index, count, total

    def rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units and shares of the given texts one after another, and how many each has."""
        sizes = self.start[rows + 1] - self.start[rows]
        at = np.repeat(self.start[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        share = self.count[at] / np.repeat(REST + self.total[rows], sizes).astype(np.float32)
        return self.index[at], share, sizes


def gathered(parts: list[tuple[np.ndarray, np.ndarray]], total: list[int]) -> Bags:
    """One set of arrays from many bags; ``parts`` is emptied on the way."""
    start = np.concatenate([[0], np.cumsum([len(i) for i, _ in parts], dtype=np.int64)]).astype(np.int64)
    index, count = np.empty(start[-1], np.int32), np.empty(start[-1], np.uint16)
    for r in range(len(parts)):
        index[start[r]:start[r + 1]], count[start[r]:start[r + 1]] = parts[r]
        parts[r] = None
    return Bags(start, index, count, np.asarray(total, np.float64))


def train(texts: list[str], labels: list[int], base_odds: float = 0.0, epochs: int = EPOCHS, seed: int = 6) -> Model:
    bags = [bag(t) for t in texts]
    seen = np.zeros(BUCKETS, np.int32)
    for index, _, _ in bags:
        seen[index] += 1
    parts = [(i[seen[i] >= SEEN], c[seen[i] >= SEEN]) for i, c, _ in bags]
    return train_bags(gathered(parts, [n for *_, n in bags]), labels, base_odds, epochs, seed)


def train_bags(bags: Bags, labels: list[int], base_odds: float = 0.0, epochs: int = EPOCHS, seed: int = 6) -> Model:
    """Joint training of embeddings and softmax by AdaGrad over mini-batches of whole documents.

    Bags hold no rare units. Classes weigh alike in the loss; ``base_odds`` is added to the bias afterwards.
    """
    y = np.asarray(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    s_emb, s_out, s_bias = np.full(BUCKETS, 1e-4, np.float32), np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    weigh = (len(y) / (2.0 * np.bincount(y, minlength=2))).astype(np.float32)
    full = np.diff(bags.start) > 0
    for _ in range(max(epochs, -(-STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            rows = order[k:k + BATCH]
            rows = rows[full[rows]]
            if not len(rows):
                continue
            index, share, sizes = bags.rows(rows)
            share = share[:, None]
            x = np.add.reduceat(emb[index] * share, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            z = x @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            t = y[rows]
            p[np.arange(len(t)), t] -= 1
            p *= weigh[t][:, None]
            g_out, g_bias = x.T @ p, p.sum(axis=0)
            g_doc = p @ out.T
            # Sum of the gradients of units that several documents of the batch hold.
            which, at = np.unique(index, return_inverse=True)
            g = np.repeat(g_doc, sizes, axis=0) * share
            g_emb = np.stack([np.bincount(at, weights=g[:, d], minlength=len(which)) for d in range(DIM)], axis=1).astype(np.float32)
            s_emb[which] += (g_emb ** 2).mean(axis=1)
            emb[which] -= RATE * g_emb / np.sqrt(s_emb[which])[:, None]
            s_out += g_out ** 2
            out -= 0.1 * g_out / np.sqrt(s_out)
            s_bias += g_bias ** 2
            bias -= 0.1 * g_bias / np.sqrt(s_bias)
    used = np.zeros(BUCKETS, np.bool_)
    used[bags.index] = True
    emb[~used] = 0
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]) + base_odds)


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 6) -> Model:
    """Model from the labelled documents that are not held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()) \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    first = [known.filter(F.col("_toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    ids = sized(first[0].unionByName(first[1]), "toxicity-sample")
    sample = docs.select("doc_id", whole_text().alias("text")).join(ids, "doc_id") \
        .groupBy("doc_id", "_toxic").agg(F.min("text").alias("text"))

    bags = materialize(sample.mapInArrow(_bags, "doc_id long, toxic int, total long, units binary, counts binary"), "toxicity-bags")
    often = bags.select("units").mapInArrow(_unit_counts, "unit int, n long").groupBy("unit").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEEN)
    kept = np.zeros(BUCKETS, np.bool_)          # at most BUCKETS numbers reach the driver, however large the sample
    kept[often.select("unit").toPandas()["unit"].to_numpy(np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(kept).tobytes())

    def only_kept(batches):
        import pyarrow as pa
        keep = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(np.bool_)
        for b in batches:
            units, counts = [], []
            for u, c in zip(b.column("units"), b.column("counts")):
                u, c = np.frombuffer(u.as_py(), "<i4"), np.frombuffer(c.as_py(), "<u2")
                k = keep[u]
                units.append(u[k].tobytes())
                counts.append(c[k].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("total"), pa.array(units, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["doc_id", "toxic", "total", "units", "counts"])

    def run(batches):
        import pyarrow as pa
        ids, labels, total, parts = [], [], [], []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            labels += b.column("toxic").to_pylist()
            total += b.column("total").to_pylist()
            parts += [(np.frombuffer(u.as_py(), "<i4"), np.frombuffer(c.as_py(), "<u2")) for u, c in zip(b.column("units"), b.column("counts"))]
        order = sorted(range(len(ids)), key=ids.__getitem__)
        parts = [parts[k] for k in order]
        m = train_bags(gathered(parts, [total[k] for k in order]), [labels[k] for k in order], seed=seed)
        yield pa.RecordBatch.from_pydict({"weight": [m.weight.tobytes()], "bias": [m.bias]})

    plain = "doc_id long, toxic int, total long, units binary, counts binary"
    model = materialize(bags.mapInArrow(only_kept, plain).repartition(1).mapInArrow(run, "weight binary, bias double"), "toxicity-model").first()
    if model is None:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(model["weight"], dtype=np.float32), model["bias"])


def _bags(batches):
    """Bags of sampled texts, made where the texts lie."""
    import pyarrow as pa
    release_caches()
    for b in batches:
        got = [bag(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("_toxic"), pa.array([n for *_, n in got], pa.int64()), pa.array([i.astype("<i4").tobytes() for i, *_ in got], pa.binary()),
             pa.array([c.astype("<u2").tobytes() for _, c, _ in got], pa.binary())], names=["doc_id", "toxic", "total", "units", "counts"])


def _unit_counts(batches):
    """In how many bags of a partition each unit is."""
    import pyarrow as pa
    n = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for u in b.column("units"):
            n[np.frombuffer(u.as_py(), "<i4")] += 1
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["unit", "n"])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default; score and predicted are replaced) with score and predicted."""
    weight = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    cols = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]

    def run(batches):
        import pyarrow as pa
        release_caches()
        m = Model(*weight.value)
        for b in batches:
            s = [m.score(t.as_py() or "") for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(s, pa.float64()),
                                              pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*cols, "score", "predicted"])

    text = "text" if "text" in cols else "_text"
    rows = docs.select(*cols) if text == "text" else docs.select(*cols, F.col("text").alias("_text"))
    kind = docs.select(*cols).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return rows.mapInArrow(run, kind)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns as they were."""
    others = [c for c in docs.columns if c != "text"]       # the text goes to the task once
    whole = docs.select(F.struct(*others).alias("_rest"), "text")
    kept = score(whole, fit(docs, labels), keep=["_rest", "text"]).filter(F.col("predicted") == 0)
    return kept.select(*(F.col("text") if c == "text" else F.col("_rest").getField(c).alias(c) for c in docs.columns))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
