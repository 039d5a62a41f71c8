"""Operator 6: held-out accuracy, unseen misspellings, awkward inputs."""
import random
import zlib

import numpy as np
from helpers import awkward, awkward_rows, empty
from pyspark.sql import functions as F

from sqlforge.llm import toxicity as T

STEMS = ["grumbolt", "fizzlewart", "snarkipod"]


def corpus(n, seed, misspell):
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = ["".join(r.choice(["an", "the", "ing", "or", "ea", "st"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 120))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(1 + len(words) // 25):
                s = r.choice(STEMS)
                if misspell:
                    at = r.randint(3, len(s) - 1)
                    s = s[:at] + r.choice("xyqz") + s[at:]
                words[r.randrange(len(words))] = s
        out.append((" ".join(words), int(bad)))
    return out


def test_unseen_misspellings():
    train, test = corpus(1200, 1, False), corpus(400, 2, True)
    m = T.train([t for t, _ in train], [y for _, y in train])
    right = np.mean([(m.score(t) >= 0.5) == (y == 1) for t, y in test])
    assert right > 0.9


def test_units_share_ngrams():
    a, b = set(T.units("grumbolt")), set(T.units("grumbbolt"))
    assert len(a & b) >= 8 and T.units("...") == [] and T.units("Word,") == T.units("Word")
    assert len(T.units("x" * 1000)) == 5 * len(T.units("x" * 200))


def test_long_texts_and_repetition_do_not_change_the_score():
    m = T.train(*zip(*[("good thing", 0), ("bad grumbolt", 1)] * 40))
    assert m.score("good thing") == m.score("good thing\n" * 1000)
    assert 0 <= m.score("") <= 1 and m.score("") == m.score(" \n")


def test_one_class_or_none():
    assert T.train([], []).score("x") == 0.5
    assert T.train(["a", "b"], [0, 0]).score("a") < 0.5 < T.train(["a", "b"], [1, 1]).score("a")


def test_held_out_rule(spark):
    df = spark.createDataFrame([(k,) for k in range(200)], "doc_id long").select("doc_id", T.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.collect())


def test_awkward_documents(spark):
    docs = awkward(spark, clash=("score", "Predicted"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 1), (100, 1, 1), (101, 0, None), (None, 1, 1), (8, 1, 0), (999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = T.score(docs, T.fit(docs, labels)).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert T.reject_toxic(awkward(spark), labels).columns == awkward(spark).columns
    none = labels.filter("doc_id < 0")
    assert {r.score for r in T.score(docs, T.fit(docs, none)).collect()} == {0.5}
    assert T.score(empty(spark), T.fit(empty(spark), labels)).count() == 0


def test_held_out_accuracy_on_documents(spark, tmp_path):
    rows = [(k, t, y) for k, (t, y) in enumerate(corpus(1500, 5, False))]
    spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = T.op6_toxicity(spark, str(tmp_path)).filter(F.col("held_out")).collect()
    truth = {k: y for k, _, y in rows}
    assert len(got) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.95


def plain_training(texts, labels, epochs, seed=6):
    """The same steps one document and one unit at a time."""
    bags = [T.bag(t) for t in texts]
    seen = np.zeros(T.BUCKETS, int)
    for i, *_ in bags:
        seen[i] += 1
    y = np.array(labels)
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (T.BUCKETS, T.DIM)), rng.normal(0, 0.1, (T.DIM, 2)), np.zeros(2)
    s_emb, s_out, s_bias = np.full(T.BUCKETS, 1e-4), np.full((T.DIM, 2), 1e-4), np.full(2, 1e-4)
    weigh = len(y) / (2.0 * np.bincount(y, minlength=2))
    for _ in range(max(epochs, -(-T.STEPS * T.BATCH // len(y)))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), T.BATCH):
            g_emb, g_out, g_bias = {}, np.zeros((T.DIM, 2)), np.zeros(2)
            for r in order[k:k + T.BATCH]:
                own = [(u, c / (T.REST + bags[r][2])) for u, c in zip(*bags[r][:2]) if seen[u] >= T.SEEN]
                if not own:
                    continue
                x = sum(emb[u] * s for u, s in own)
                z = x @ out + bias
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                p[y[r]] -= 1
                p *= weigh[y[r]]
                g_out += np.outer(x, p)
                g_bias += p
                for u, s in own:
                    g_emb[u] = g_emb.get(u, 0) + s * (out @ p)
            for u, g in g_emb.items():
                s_emb[u] += (g ** 2).mean()
                emb[u] -= T.RATE * g / np.sqrt(s_emb[u])
            s_out += g_out ** 2
            out = out - 0.1 * g_out / np.sqrt(s_out)
            s_bias += g_bias ** 2
            bias = bias - 0.1 * g_bias / np.sqrt(s_bias)
    emb[seen < T.SEEN] = 0
    return emb @ (out[:, 1] - out[:, 0]), bias[1] - bias[0]


def test_training_against_plain_steps(monkeypatch):
    monkeypatch.setattr(T, "STEPS", 4)
    texts, labels = zip(*[(t[:200], y) for t, y in corpus(70, 8, False)])
    m = T.train(list(texts) + [""], list(labels) + [0], epochs=2)
    weight, bias = plain_training(list(texts) + [""], list(labels) + [0], 2)
    assert abs(m.bias - bias) < 1e-3 and np.abs(m.weight - weight).max() < 2e-3 and np.abs(weight).max() > 0.05


def test_distributed_bags_give_the_same_model(spark):
    rows = [(k, t, y) for k, (t, y) in enumerate(corpus(120, 9, False))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    want = T.train([r[1] for r in used], [r[2] for r in used])
    got = T.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert abs(got.bias - want.bias) < 1e-4 and np.abs(got.weight - want.weight).max() < 1e-4
