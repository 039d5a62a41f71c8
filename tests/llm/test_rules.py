"""Operator 11: tree paths, lasso, compiled columns against numpy, held-out accuracy, awkward inputs."""
import random
import zlib

import numpy as np
from helpers import awkward, awkward_rows, empty, prose
from pyspark.sql import functions as F

from sqlforge.llm import rules as R

LABELS = "doc_id long, quality int, toxic int"


def junk(seed):
    r = random.Random(seed)
    kind = seed % 4
    words = prose(seed, r.randint(20, 200)).split()
    if kind == 0:
        return " ".join(w + r.choice(["&&&", "%%%", "***"]) for w in words)
    if kind == 1:
        return "\n".join([" ".join(words[:12])] * 20)
    if kind == 2:
        return " | ".join(words)
    return "!! ".join(w.upper() for w in words)


def corpus(n, first=0):
    return [(first + k, junk(first + k) if k % 4 == 0 else prose(first + k, 30 + k % 200), int(k % 4 != 0)) for k in range(n)]


def test_every_path_of_a_tree_is_a_rule_and_leaves_share_out_the_rows():
    r = np.random.default_rng(1)
    x = r.random((500, 3))
    left = (x[:, 0] > 0.5) * 1.0 + (x[:, 1] > 0.3) * 0.5 + r.normal(0, 0.01, 500)
    cuts = [np.linspace(0.1, 0.9, 9)] * 3
    rules, leaves = R.grow(x, cuts, left, np.arange(500))
    member = np.stack([R.holds(p, x) for p, _ in leaves])
    assert (member.sum(axis=0) == 1).all() and all(m.sum() >= R.LEAF_ROWS for m in member)
    assert {p for p, _ in leaves} <= set(rules) and len(rules) == 2 * (len(leaves) - 1)
    for p, value in leaves:
        assert abs(left[R.holds(p, x)].mean() - value) < 1e-9
    assert any(j == 0 and abs(cut - 0.5) < 0.06 for rule in rules for j, _, cut in rule)


def test_first_split_is_the_best_of_all():
    r = np.random.default_rng(4)
    x, left = r.random((120, 4)), r.normal(size=120)
    cuts = [np.unique(x[:, j])[:-1] for j in range(4)]

    def error(j, c):
        a, b = left[x[:, j] <= c], left[x[:, j] > c]
        return ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()

    best = min(error(j, c) for j in range(4) for c in cuts[j] if R.LEAF_ROWS <= (x[:, j] <= c).sum() <= 120 - R.LEAF_ROWS)
    rules, _ = R.grow(x, cuts, left, np.arange(120), depth=1)
    (j, _, c), = rules[0]
    assert abs(error(j, c) - best) < 1e-9


def test_lasso_meets_its_optimality_conditions():
    r = np.random.default_rng(2)
    z = (r.random((600, 12)) < 0.4).astype(float)
    y = (r.random(600) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 1])))).astype(float)
    weigh = np.where(y == 1, 0.5, 1.5)
    w, bias = R.lasso(z, y, weigh, penalty=0.02, rounds=5000)
    p = 1 / (1 + np.exp(-(z @ w + bias)))
    g = z.T @ (weigh / weigh.sum() * (p - y))
    assert abs((weigh / weigh.sum() * (p - y)).sum()) < 1e-6
    for k in range(12):
        assert abs(g[k] + 0.02 * np.sign(w[k])) < 1e-5 if w[k] else abs(g[k]) <= 0.02 + 1e-6
    assert w[0] > 0 > w[1] and (w == 0).sum() >= 6


def test_compiled_column_equals_the_rules(spark):
    rows = [(k, t) for k, t, _ in corpus(300)] + [(-1, ""), (-2, None), (-3, " \n")]
    x = np.array([R.statistics_of(t) for _, t in rows])
    m = R.train(x[:300], np.array([y for _, _, y in corpus(300)], float))
    assert 0 < len(m.rules) <= 150 and m.describe()
    want = dict(zip((k for k, _ in rows), m.score(x)))
    got = {r.doc_id: r.score for r in R.score(spark.createDataFrame(rows, "doc_id long, text string"), m, ["doc_id"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_statistics():
    assert R.statistics_of(None) == R.statistics_of("") == R.statistics_of(" \n\t") == [0.0] * len(R.STATISTICS)
    s = dict(zip(R.STATISTICS, R.statistics_of("Ab c1 ###\nAb c1 ###\n| é.")))
    assert abs(s["repeated_lines"] - 1 / 3) < 1e-12 and s["pipes"] == 1 / 8 and abs(s["bare_words"] - 3 / 8) < 1e-12 and s["ended_lines"] == 1 / 3
    long = R.statistics_of(prose(1, 50_000))
    assert all(np.isfinite(long))


def test_held_out_rule(spark):
    df = spark.createDataFrame([(k,) for k in range(200)], "doc_id long").select("doc_id", R.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())


def test_awkward_documents(spark):
    docs = awkward(spark, clash=("score", "Predicted", "_s0", "_k0", "_text"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (100, 0, 1), (101, None, 0), (None, 1, 1), (8, 1, 0), (999, 1, 1), (11, 7, 0)], LABELS)
    out = R.score(docs, R.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_s0", "_k0", "_text", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r._text == "other" for r in got)
    assert {r.score for r in R.score(docs, R.fit(docs, labels.filter("doc_id < 0"))).collect()} == {0.5}
    assert {r.predicted for r in R.score(docs, R.fit(docs, labels.filter("doc_id = 8"))).collect()} == {0}
    assert R.score(empty(spark), R.fit(empty(spark), labels)).count() == 0


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus(1600)
    spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, y, 0) for k, _, y in rows], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    got = R.op11_rule_quality(spark, str(tmp_path)).filter(F.col("held_out")).collect()
    truth = {k: y for k, _, y in rows}
    assert len(got) > 300 and np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.97
