"""Operator 12: the tree, proofs and foldings against a plain recomputation of the whole tree."""
import hashlib
import random
import zlib

import pytest
from helpers import awkward, awkward_rows, empty
from pyspark.sql import functions as F

from sqlforge.llm import merkle as M

LOWER = str.maketrans(M.UPPER, M.LOWER)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain(rows):
    """The rows of the operator, by building every tree anew for each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), r))
    groups = {g: sorted(v, key=lambda x: x[:3]) for g, v in groups.items()}
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([x[2] for x in v]) for g, v in groups.items()}
    top = plain_levels([trees[g][-1][0] for g in names])

    def proof(levels, at):
        out = ""
        for level in levels[:-1]:
            run = at // 16 * 16
            out += "".join(x for k, x in enumerate(level[run:run + 16], run) if k != at)
            at //= 16
        return out

    out = []
    for g in names:
        for k, (_, _, leaf, r) in enumerate(groups[g]):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = text.translate(LOWER)
            leaves = list(trees[g][0])
            leaves[k] = plain_leaf(r, text)
            subs = list(top[0])
            subs[names.index(g)] = plain_levels(leaves)[-1][0]
            root = plain_levels(subs)[-1][0]
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(proof(trees[g], k) + proof(top, names.index(g))), root, root == top[-1][0]))
    return out


def got(df):
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()]


def check(df, rows):
    order = lambda x: str(x)
    assert sorted(got(M.manifest(df)), key=order) == sorted(plain(rows), key=order)


def rows_of(n, source, first=0):
    r = random.Random(n)
    return [(first + k, r.choice(["Some Text", "", None, "lower only", "É Ü Z"]) , r.choice(["en", None]), source, r.choice([1, None])) for k in range(n)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_sizes_around_the_runs_and_tiers(spark):
    rows, at = [], 0
    for k, n in enumerate((1, 2, 15, 16, 17, 33, 255, 256, 257, 300)):
        rows += rows_of(n, f"s{k}", at)
        at += n
    check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows)


def test_several_tiers(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)     # three tiers over 300 leaves, two over 20 sources
    rows = [(k, f"Text {k}", "en", f"s{k % 20}" if k % 3 else "hot", k) for k in range(900)]
    check(spark.createDataFrame(rows, SCHEMA), rows)


def test_awkward_rows(spark):
    check(awkward(spark, clash=("leaf", "grp", "idx", "value", "root", "part")), awkward_rows())


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single(spark, n):
    rows = [(7, "One Row", None, None, 3)][:n]
    check(spark.createDataFrame(rows, SCHEMA) if n else empty(spark), rows)
    if n:
        r = M.manifest(spark.createDataFrame(rows, SCHEMA)).first()
        assert r.leaf == r.subroot == r.root and r.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_fold_takes_only_the_replacement_and_what_lies_right(spark):
    children = [h(str(k)).encode() for k in range(16)]
    p = M.Parent(children)
    for slot in range(16):
        changed = children[:slot] + [h("x").encode()] + children[slot + 1:]
        assert p.fold(slot, h("x").encode()) == M.Parent(changed).value == M.digest(*changed)
        assert p.before[slot].hexdigest() == h(*(c.decode() for c in children[:slot])) and p.right[slot] == b"".join(children[slot + 1:])


def test_many_equal_rows(spark):
    rows = [(None, "Same", "en", "hot", 1)] * 1500 + rows_of(40, "b")
    df = spark.createDataFrame(rows, SCHEMA)
    check(df, rows)
    assert M.manifest(df).filter(F.col("doc_id").isNull() & ~F.col("verified")).count() == 0
