"""Operator 2: the index against brute force."""
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sqlforge.llm import bitsliced as B


def brute(rows, k):
    ok = [(i, r, [int(np.floor(1024.0 * np.float64(x))) for x in v]) for r, (i, v) in enumerate(rows)
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, r, v in ok:
        if i is None or i % 100:
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, s) for j, s, w in ok if s != r and len(w) == len(v))[:k]
        out += [(i, n + 1, None if null else j, -s) for n, (s, null, j, _) in enumerate(best)]
    return sorted(out, key=str)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 150), st.integers(1, 9), st.sampled_from([1, 3, 200, 10 ** 6]), st.integers(0, 10 ** 6))
def test_no_row_of_the_top_is_lost(n, d, scale, seed):
    r = np.random.default_rng(seed)
    v, w = r.integers(-scale, scale + 1, (n, d)), r.integers(-scale, scale + 1, (5, d))
    q, rows, score = B.Slices(v).top(w, 4)
    exact = w @ v.T
    assert (score == exact[q, rows]).all()
    for i in range(5):
        need = np.sort(exact[i])[::-1][:4][-1]
        assert set(np.flatnonzero(exact[i] >= need)) <= set(rows[q == i])


def test_sums_bound_the_score():
    r = np.random.default_rng(1)
    v, w = r.integers(-500, 500, (130, 12)), r.integers(-500, 500, (7, 12))
    levels, base, step, width = B.Slices(v).sums(w)
    s = sum(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64) << p for p, x in enumerate(levels))
    low = base[:, None] + step[:, None] * s
    exact = w @ v.T
    assert (low <= exact).all() and (exact <= low + width[:, None]).all()


@pytest.mark.parametrize("k", [1, 3, 10])
def test_awkward_vectors(spark, k, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, .2, 4)]) for i in range(0, 420, 4)]
    rows += [(0, rows[0][1]), (100, [0.0, 0.0, 0.0, 0.0]), (7, None), (200, [0.1, None, 0.2, 0.3]), (300, [float("nan"), 0.0, 0.0, 0.0]),
             (400, [float("inf"), 0.0, 0.0, 0.0]), (None, rows[3][1]), (500, [1.0, 2.0]), (501, [1.0, -2.0]), (600, [0.5]), (602, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    have = B.valid(df, "vec_id", "embedding")
    got = B.top_k(have, have.filter("pmod(id, 100) = 0"), k).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k)


def test_empty(spark):
    have = B.valid(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert B.top_k(have, have).count() == 0
