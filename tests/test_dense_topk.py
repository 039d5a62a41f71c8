"""Exact dense top-k equals full scoring; blocks that can't reach a query's k best are left out."""
import numpy as np
import pytest

from sqlforge.operators import dense_topk as D


def plain(q, h, k):
    out = {}
    for g, i, v in q:
        with np.errstate(all="ignore"):
            cos = [(float(np.nan_to_num(round(float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), 9), posinf=0, neginf=0)), j) for hg, j, w in h if hg == g]
        out.update({(g, i, r): (j, s) for r, (s, j) in enumerate(sorted(cos, key=lambda x: (-x[0], x[1]))[:k], 1)})
    return out


def got(spark, q, h, k, block):
    rows = lambda t: spark.createDataFrame([(g, i, [float(x) for x in v]) for g, i, v in t], "g long, id long, vec array<double>")
    return {(r.g, r.q, r["rank"]): (r.h, r.sim) for r in D.dense_topk(rows(q), rows(h), k, block).collect()}


def same(a, b):
    assert a.keys() == b.keys()
    assert all(abs(a[x][1] - b[x][1]) < 2e-9 and (a[x][0] == b[x][0] or abs(a[x][1] - b[x][1]) < 2e-9) for x in a)


@pytest.mark.parametrize("dim,block", [(3, 8), (16, 16)])
def test_against_full_scoring(spark, dim, block):
    r = np.random.default_rng(dim)
    q = [(n % 3 if n % 2 else 0, n, r.normal(size=dim)) for n in range(90)] + [(7, 900, r.normal(size=dim))]
    h = [(n % 3 if n % 2 else 0, n, r.normal(size=dim)) for n in range(200)] + [(0, 500, np.zeros(dim)), (1, 501, np.full(dim, np.nan))]
    q += [(0, 901, np.zeros(dim)), (2, 902, h[5][2] * 3)]
    same(got(spark, q, h, 3, block), plain(q, h, 3))


def test_ties_go_to_the_smaller_id_and_small_groups_stay_short(spark):
    h = [(0, n, [1.0, float(n % 2)]) for n in range(60)] + [(1, 5, [1.0, 0.0])]
    q = [(0, 1, [1.0, 0.0]), (0, 2, [1.0, 1.0]), (1, 3, [0.0, 1.0])]
    out = got(spark, q, h, 3, 8)
    assert [out[0, 1, r][0] for r in (1, 2, 3)] == [0, 2, 4] and [out[0, 2, r][0] for r in (1, 2, 3)] == [1, 3, 5] and out[1, 3, 1] == (5, 0.0)
    assert (1, 3, 2) not in out


def test_blocks_are_left_out_where_directions_differ(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 8))
    rows = [(0, n, (centres[n % 40] + r.normal(scale=0.02, size=8)).tolist()) for n in range(2000)]
    df = spark.createDataFrame(rows, "g long, id long, vec array<double>")
    qb, hb = D._blocks(df, 64, "q"), D._blocks(df, 64, "h")
    pairs = D.materialize(D.block_pairs(qb, hb), "pairs")
    w = D.Window.partitionBy("g", "qblk").orderBy(D.F.col("bound").desc(), "hblk")
    first = pairs.withColumn("_r", D.F.row_number().over(w)).filter("_r = 1").drop("_r")
    found = D.materialize(D._scored(first, qb, hb, 3), "found")
    scored = first.count() + D.wanted_pairs(pairs, first, found, qb, 3).count()
    assert scored < 0.5 * pairs.count(), (scored, pairs.count())


def test_empty_sides(spark):
    none = spark.createDataFrame([], "g long, id long, vec array<double>")
    one = spark.createDataFrame([(0, 1, [1.0]), (0, 2, None)], "g long, id long, vec array<double>")
    assert D.dense_topk(none, one, 3).count() == 0 and D.dense_topk(one, none, 3).count() == 0 and D.dense_topk(one, one, 3).count() == 1


def test_floors_keep_the_best_with_ties_and_zero_rows():
    r = np.random.default_rng(3)
    q = D.unit(r.integers(0, 3, (60, 4)).astype(float))
    q[7] = 0.0
    items = [(D.unit(r.integers(0, 3, (n, 4)).astype(float)), r.permutation(n) + 1000 * b) for b, n in enumerate((1, 2, 200, 40, 500))]
    got = {}
    for row, h, s in zip(*D.best_of_blocks(q, items, 3)):
        got.setdefault(int(row), []).append((int(h), float(s)))
    m, ids = np.concatenate([x for x, _ in items]), np.concatenate([x for _, x in items])
    sims = np.round(q @ m.T, D.SIM_SCALE) + 0.0
    assert got == {n: [(int(ids[c]), float(sims[n, c])) for c in np.lexsort((ids, -sims[n]))[:3]] for n in range(60)}


def test_cosines_far_below_the_best_are_not_sorted(monkeypatch):
    sorted_rows = []
    lexsort = np.lexsort
    monkeypatch.setattr(D.np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
    r = np.random.default_rng(4)
    items = [(D.unit(r.normal(size=(1024, 26))), np.arange(1024) + 1024 * b) for b in range(4)]
    D.best_of_blocks(D.unit(r.normal(size=(256, 26))), items, 3)
    assert sum(sorted_rows) < 256 * 4 * 30      # of 256 * 4096 cosines


def test_equal_queries_are_one_row_and_all_get_the_best(spark):
    r = np.random.default_rng(5)
    few = r.integers(0, 4, (9, 6)).astype(float)
    q = [(n % 2, n, few[n % 9]) for n in range(300)]
    h = [(n % 2, n, r.integers(0, 4, 6).astype(float)) for n in range(400)] + [(0, 1000 + n, few[3]) for n in range(40)]
    same(got(spark, q, h, 3, 16), plain(q, h, 3))
    rows = spark.createDataFrame([(g, i, v.tolist()) for g, i, v in q], "g long, id long, vec array<double>")
    blocks = D._blocks(rows, 1024, "q").select("ids", "at", "vecs").collect()
    assert sum(len(b.ids) for b in blocks) == 300 and sum(len(b.vecs) for b in blocks) <= 2 * 9 * 6 * 8
    assert all(len(b.at) == len(b.ids) and max(b.at) + 1 == len(b.vecs) // 48 for b in blocks)


def test_rows_of_one_id_share_its_places(spark):
    h = [(0, n, [1.0, float(n)]) for n in range(5)] + [(0, 0, [1.0, 0.0])]
    out = got(spark, [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.0]), (0, 2, [0.0, 1.0])], h, 5, 4)
    assert [out[0, 1, r] for r in range(1, 6)] == [(0, 1.0)] * 4 + [(1, 0.707106781)] and (0, 1, 6) not in out
    assert [out[0, 2, r][0] for r in range(1, 6)] == [0, 0, 4, 3, 2]


def test_rows_that_cannot_reach_their_floor_are_not_scored(monkeypatch):
    scored, pair = [], D.best_of_pair
    monkeypatch.setattr(D, "best_of_pair", lambda q, *a: scored.append(len(q)) or pair(q, *a))
    r = np.random.default_rng(6)
    def ball(centre, first):
        m = D.unit(centre + r.normal(scale=0.05, size=(64, 5)))
        pivot = D.unit(m.mean(axis=0, keepdims=True))[0]
        return m, np.arange(64) + first, pivot, float(np.arccos(np.clip(m @ pivot, -1, 1)).max())
    items = [ball(np.eye(5)[n], 64 * n) for n in range(5)]
    q = D.unit(np.concatenate([np.eye(5)[n] + r.normal(scale=0.05, size=(20, 5)) for n in range(5)]))
    row, h, s = D.best_of_blocks(q, items, 3)
    floor = D._kth(row, s, 3, 100)
    scored.clear()
    again = D.best_of_blocks(q, items, 3, floor)
    assert all((a == b).all() for a, b in zip((row, h, s), again)) and sum(scored) == 100      # of 500: each row with its own block only
    sims = np.round(q @ np.concatenate([m for m, *_ in items]).T, D.SIM_SCALE)
    assert h.tolist() == [int(c) for n in range(100) for c in np.lexsort((np.arange(320), -sims[n]))[:3]]
