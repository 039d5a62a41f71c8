"""Operator 9: Golay keys, fingerprints and components against brute force."""
import itertools

import numpy as np
import pytest
import xxhash
from helpers import SF_SMALL, SPACE, awkward, awkward_rows, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sqlforge.llm import golay as G
from sqlforge.llm import simhash as S
from sqlforge.llm.components import components


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPACE.findall(text)
    if not w:
        return 0
    grams = [" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def plain_components(prints):
    """Smallest index reachable over pairs at 4 or fewer bits."""
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(range(len(prints)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 4:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def test_code_is_perfect():
    words = np.arange(1 << 23)
    index = G.codeword_index(words)
    assert (np.bincount(index) == 2048).all()
    code = (words ^ G._ERROR[G.syndrome(words)])
    assert np.bitwise_count(words ^ code).max() == 3
    assert set(np.unique([len(set(k[k >= 0])) for k in G.key_sets(np.arange(5000), 23)])) == {1, 6}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2 ** 64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_no_linked_pair_is_without_a_common_key(a, flips):
    b = a ^ sum(1 << f for f in flips)
    rows, keys = G.joint_keys(np.array([a, b], dtype=np.uint64))
    assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_fingerprint():
    for r in awkward_rows():
        assert S.fingerprint(r[1]) == plain_print(r[1]), r[1]
    assert S.fingerprint("A b C d E") == S.fingerprint("a B c D\te") != 0
    assert S.fingerprint("\x1cx\x85 É") == plain_print("\x1cx\x85 É")


def clusters(seed):
    """Chains and stars of near fingerprints around random centres, zero among them."""
    r = np.random.default_rng(seed)
    out = [0, 1, 3, 2 ** 64 - 1]
    for _ in range(25):
        c = int(r.integers(0, 2 ** 63)) * 2 + 1
        for _ in range(int(r.integers(1, 12))):
            out.append(c)
            for f in r.choice(64, int(r.integers(1, 7)), replace=False):
                c ^= 1 << int(f)
    return out


@pytest.mark.parametrize("run_rows", [1 << 15, 2])
def test_components_equal_brute_force(spark, run_rows):
    prints = clusters(run_rows)
    rows = spark.createDataFrame([(np.uint64(p).astype(np.int64).item(),) for p in prints], "_fp long")
    links = S.links(rows.distinct(), run_rows=run_rows)
    assert all(bin((r.a ^ r.b) & (2 ** 64 - 1)).count("1") <= 4 for r in links.collect())
    roots = {r.node: r.root for r in components(links).collect()}
    got = {}
    want = plain_components(prints)
    for p, w in zip(prints, want):
        s = np.uint64(p).astype(np.int64).item()
        got.setdefault(roots.get(s, s), set()).add(w)
    assert all(len(v) == 1 for v in got.values()) and len(got) == len(set(want))


def test_awkward_documents(spark):
    docs = awkward(spark, clash=("_fp", "fingerprint", "_row"))
    rows = S.fingerprints(docs, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(awkward_rows()) and all(r._fp % 2 ** 64 == plain_print(r.text) for r in rows)
    kept = S.one_per_group(awkward(spark)).collect()
    unique = [(r[0], plain_print(r[1])) for r in awkward_rows()]
    roots = plain_components([p for _, p in unique])
    best = {}
    for (d, _), k in zip(unique, roots):
        best[k] = min(best.get(k, (True, 0)), (d is None, d or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(best.values())
    assert kept[0].asDict().keys() == awkward(spark).limit(1).collect()[0].asDict().keys()


def test_components_of_a_star_a_chain_and_a_loop(spark):
    links = [(100, k) for k in range(300)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(300)} | {1000 + k: 1000 for k in range(71)} | {2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert S.one_per_group(empty(spark)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_print(d.text) for d in docs]
    want = {d.doc_id: (format(p, "016x"), docs[k].doc_id) for d, p, k in zip(docs, prints, plain_components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in S.op9_simhash_golay(spark, SF_SMALL).collect()} == want


def test_copies_do_not_multiply(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.lit("the same text for all of them").alias("text"))
    assert S.one_per_group(df).collect()[0].doc_id == 0
