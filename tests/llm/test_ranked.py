"""Operator 13: scores and order against plain scoring of all documents; the reads of NRA."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, awkward_rows, empty, prose

from sqlforge.llm import ranked as R

TERM = re.compile(R.TERM)
LOWER = str.maketrans(R.UPPER, R.LOWER)


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=R.K):
    counted = [(d, Counter(words(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    big_n, big_l = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r, None if void else d, -s) for r, (s, void, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


ITEMS = [(1, "the rest of straße ÉTÉ été Lyon"), (2, "token reason"), (2, "thinger42 ion"), (3, None), (4, ""), (5, "-- !"), (None, "the ouha"),
         (6, "absentword"), (7, "the"), (8, "one ONE one"), (9, prose(104, 60))]


@pytest.mark.parametrize("block_rows,query_rows", [(4096, 512), (5, 2)])
def test_awkward_documents(spark, block_rows, query_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = R.search(awkward(spark, clash=("rank", "term", "item", "score", "block")), items, block_rows=block_rows, query_rows=query_rows)
    assert got(df) == plain([(r[0], r[1]) for r in awkward_rows()], ITEMS)


def test_many_ties_over_blocks(spark):
    docs = [(k, ("alpha beta", "alpha beta gamma", "beta")[k % 3]) for k in range(300)] + [(None, "alpha beta")] * 3 + [(7, "alpha beta")]
    items = [(1, "alpha"), (2, "beta gamma alpha")]
    df = R.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"), block_rows=16)
    assert got(df) == plain(docs, items)


def test_random_corpora(spark):
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    docs = [(k, " ".join(r.choices(vocab, weights, k=r.randint(0, 90)))) for k in range(700)]
    items = [(k, " ".join(r.choices(vocab, k=r.randint(1, 25)))) for k in range(30)] + [(99, docs[5][1])]
    df = R.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), block_rows=64)
    assert got(df) == plain(docs, items)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert R.search(empty(spark), items).count() == 0
    assert R.search(awkward(spark), items.limit(0)).count() == 0


def lists_of(seed, n, terms):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(terms):
        p = r.choice(n, r.integers(1, n + 1), replace=False)
        imp = np.sort(r.integers(1, 50, len(p)) * int(r.integers(1, 2000)))[::-1]
        out.append((p, imp))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_nra_against_full_sums(seed):
    n = 5 + seed * 40
    lists = lists_of(seed, n, 1 + seed % 9)
    full = np.zeros(n, np.int64)
    for p, imp in lists:
        full[p] += imp
    best = sorted((-s, d) for d, s in enumerate(full) if s > 0)[:10]
    where, score, read = R.nra(lists, n, 10, stride=4)
    mine = sorted((-s, d) for d, s in zip(where, score))[:10]
    assert mine == best and read <= sum(len(p) for p, _ in lists)
    assert all(full[d] == s for d, s in zip(where, score))
    low = R.nra(lists, n, 10, rounds=1, stride=4)
    assert all(full[d] >= s for d, s in zip(*low[:2]))
    floor = -best[-1][0]
    where, score, _ = R.nra(lists, n, 10, floor, stride=4)
    assert sorted((-s, d) for d, s in zip(where, score))[:10] == best


def test_nra_stops_before_the_ends():
    n = 5000
    places = np.arange(n)
    top = np.where(places < 10, 10_000 - places, 10)
    lists = [(places, top), (places, top)]
    where, score, read = R.nra(lists, n, 10)
    assert list(where) == list(range(10)) and read < n / 10
    assert R.nra(lists, n, 10, floor=30_000)[2] == 0


def test_terms():
    assert [t.decode() for t in R.terms_of("A-b_C9 Émile x\u0000y z 'q'")] == words("A-b_C9 Émile x\u0000y z 'q'")
    assert R.terms_of(None) == R.terms_of("  ..") == []
