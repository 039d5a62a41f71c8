"""Merkle dataset manifest: a SHA-256 tree over documents with midstates for folding (operator 12).

H is the lowercase hex SHA-256 of its inputs one after another, digests as hex text. A leaf is H of a row's
fields; per source the leaves ascend by doc_id, and while there are several nodes every ``FANOUT``
consecutive ones become their H. The last one is the source's subroot, and the subroots, by source, give the root likewise.

A parent is one running SHA-256 state that takes its children in order. Before each child it keeps a copy of
the state (``Parent``): folding a changed child resumes the copy of its slot and takes in the replacement and
the siblings to the right, never those to the left.

The tree is built in tiers of ``LEVELS`` levels, so a task holds the at most ``FANOUT ** LEVELS`` nodes of one
subtree, whatever the size of the source. Going up, a tier hands one node per subtree to the next. Going
down, each subtree gets its path above: one (left siblings, right siblings) pair per level, for which a task keeps one state
more. Proofs and foldings of a subtree's leaves share all of these. Leaves travel as 32 bytes and texts don't travel.

Defined results: a null field is ``-`` in its leaf and an empty text ``0:``; null doc_ids come first in their
source and are never tampered with; a null source is the first source; rows equal in all five
fields give equal leaves side by side, each with its own place and proof; other columns are not read,
whatever their names; an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import group_row_number
from .common import documents, materialize

FANOUT = 16
LEVELS = 2          # levels of a tier: subtrees of 256 leaves
TAMPER = 5          # rows whose crc32(doc_id) it divides are folded from a changed leaf
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------------ one parent
def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Parent:
    """A node over the hex digests of its children, with the hash state before each of them."""

    def __init__(self, children: list[bytes]):
        state = hashlib.sha256()
        self.children, self.before = children, []
        for c in children:
            self.before.append(state.copy())
            state.update(c)
        self.value = state.hexdigest().encode()
        self.right = [b"".join(children[k + 1:]) for k in range(len(children))]
        self.siblings = [b"".join(children[:k]) + r for k, r in enumerate(self.right)]

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """Value with another child in a slot: the kept state goes on with it and what lies to its right."""
        state = self.before[slot].copy()
        state.update(replacement)
        state.update(self.right[slot])
        return state.hexdigest().encode()


class Above:
    """The parents over a subtree, known by the siblings left and right of it: one kept state a level."""

    def __init__(self, path: list[tuple[bytes, bytes]]):
        self.levels = [(hashlib.sha256(left), right) for left, right in path]
        self.siblings = b"".join(left + right for left, right in path)

    def fold(self, value: bytes) -> bytes:
        for before, right in self.levels:
            state = before.copy()
            state.update(value)
            state.update(right)
            value = state.hexdigest().encode()
        return value


def subtree(nodes: list[bytes], levels: int) -> list[list[Parent]]:
    """Parents of each level over consecutive nodes, lowest first."""
    out = []
    for _ in range(levels):
        out.append([Parent(nodes[k:k + FANOUT]) for k in range(0, len(nodes), FANOUT)])
        nodes = [p.value for p in out[-1]]
    return out


# ------------------------------------------------------------------ tiers
def _depth(n: Column) -> Column:
    """Levels until n nodes are one, this tier's at most: FANOUT ** (k - 1) < n counts a level."""
    return sum(F.when(n > FANOUT ** k, F.lit(1)).otherwise(F.lit(0)) for k in range(LEVELS))


def _tier(nodes: DataFrame, keys: str) -> DataFrame:
    """(grp, idx, value binary, ...) with the columns of a tier: part (subtree), levels, slot in the subtree."""
    n = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    n = materialize(n.select("grp", _depth(F.col("_n")).cast("int").alias("levels")), keys + "-groups")
    size = FANOUT ** LEVELS
    return nodes.join(n, "grp").withColumn("part", F.floor(F.col("idx") / size).cast("long")) \
        .withColumn("slot", F.pmod("idx", F.lit(size)).cast("int"))


def _up(tier: DataFrame) -> DataFrame:
    """One node per subtree: (grp, idx, value)."""
    def build(key, table):
        t = table.sort_by("slot")
        nodes = [v.hex().encode() for v in t.column("value").to_pylist()]
        top = subtree(nodes, t.column("levels")[0].as_py())
        value = top[-1][0].value if top else nodes[0]
        return pa.table({"grp": [key[0].as_py()], "idx": pa.array([key[1].as_py()], pa.int64()),
                         "value": pa.array([bytes.fromhex(value.decode())], pa.binary())})

    return tier.select("grp", "part", "levels", "slot", "value").groupBy("grp", "part").applyInArrow(build, "grp string, idx long, value binary")


PATH = "array<struct<left:binary,right:binary>>"


def _down(tier: DataFrame, above: DataFrame) -> DataFrame:
    """The path of every node of a tier to the root: (grp, idx, top, path), ``above`` being that of its subtrees."""
    def paths(key, nodes, over):
        t = nodes.sort_by("slot")
        values = [v.hex().encode() for v in t.column("value").to_pylist()]
        top = subtree(values, t.column("levels")[0].as_py())
        rest, out = over.column("path")[0].as_py(), []
        for k in range(len(values)):
            own, at = [], k
            for level in top:
                p, s = level[at // FANOUT], at % FANOUT
                own.append({"left": b"".join(p.children[:s]), "right": p.right[s]})
                at //= FANOUT
            out.append(own + rest)
        path = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
        return pa.table({"grp": t.column("grp"), "idx": t.column("idx"), "top": pa.array([over.column("top")[0].as_py()] * len(t), pa.binary()),
                         "path": pa.array(out, path)})

    cols = tier.select("grp", "part", "levels", "slot", "idx", "value")
    return cols.groupBy("grp", "part").cogroup(above.groupBy("grp", "part")).applyInArrow(paths, f"grp string, idx long, top binary, path {PATH}")


def _climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Tiers from the nodes up, each written, and (grp, value) with the one node left of each group."""
    tiers = []
    while True:
        tiers.append(materialize(_tier(nodes, name), name + "-tier"))
        nodes = materialize(_up(tiers[-1]), name + "-nodes")
        if nodes.filter("idx > 0").isEmpty():       # a tier takes FANOUT ** LEVELS nodes to one
            return tiers, nodes.select("grp", "value")


def _as_subtrees(paths: DataFrame) -> DataFrame:
    return paths.withColumnRenamed("idx", "part")


# ------------------------------------------------------------------ leaves
def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """SHA-256 (hex) of a row's fields, with another text if one is given."""
    cols = [F.col(c) for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return F.sha2(F.concat(*map(_field, cols)), 256)


def tampered() -> Column:
    """The leaf after the text's A-Z are lower-cased, in rows that the tamper rule picks; else null."""
    picked = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER)) == 0
    return F.when(picked & F.col("text").isNotNull(), leaf(F.translate("text", UPPER, LOWER)))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root and verified for every row of ``docs``."""
    rows = docs.select(*FIELDS).select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("grp"),
                                       F.unhex(leaf()).alias("value"), F.unhex(tampered()).alias("changed"))
    # Rows that are equal in all fields may stand in any order; the number spreads them over partitions.
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "manifest-leaves")
    leaves = group_row_number(rows, ["grp"], ["doc_id", "value", "_row"], "idx").drop("_row").withColumn("idx", F.col("idx") - 1)
    tiers, subroots = _climb(leaves, "manifest")
    over = group_row_number(subroots.select("grp", "value"), [], ["grp"], "idx")
    over = over.select(F.lit("").alias("grp"), (F.col("idx") - 1).alias("idx"), "value", F.col("grp").alias("name"))
    tops, root = _climb(over, "manifest-sources")
    paths = root.select("grp", F.lit(0).cast("long").alias("part"), F.col("value").alias("top"), F.array().cast(PATH).alias("path"))
    for t in reversed(tops):
        paths = _as_subtrees(_down(t, paths))
    # Each source's subroot is the one subtree over its highest tier.
    names = tops[0].select("idx", "name", "value")
    paths = materialize(paths.withColumnRenamed("part", "idx").join(names, "idx")
                        .select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("part"), "top", "path", F.col("value").alias("subroot")), "manifest-paths")
    subs = paths.select("grp", F.col("subroot"))
    paths = paths.drop("subroot")
    for t in reversed(tiers[1:]):
        paths = materialize(_as_subtrees(_down(t, paths)), "manifest-paths")
    return _fold(tiers[0], paths.join(subs, "grp"))


def _fold(tier: DataFrame, above: DataFrame) -> DataFrame:
    def fold(key, nodes, over):
        t = nodes.sort_by("slot")
        values = [v.hex().encode() for v in t.column("value").to_pylist()]
        changed = [v and v.hex().encode() for v in t.column("changed").to_pylist()]
        top = subtree(values, t.column("levels")[0].as_py())
        up = Above([(x["left"], x["right"]) for x in over.column("path")[0].as_py()])
        root = over.column("top")[0].as_py().hex().encode()
        proofs, folded = [], []
        for k, own in enumerate(values):
            proof, value, at = hashlib.sha256(), changed[k] or own, k
            for level in top:
                p, s = level[at // FANOUT], at % FANOUT
                proof.update(p.siblings[s])
                value = p.fold(s, value)
                at //= FANOUT
            proof.update(up.siblings)
            proofs.append(proof.hexdigest())
            folded.append(up.fold(value).decode())
        sub = over.column("subroot")[0].as_py().hex()
        n = len(values)
        return pa.table({"doc_id": t.column("doc_id"), "grp": t.column("grp"), "leaf": [v.decode() for v in values], "subroot": [sub] * n,
                         "root": [root.decode()] * n, "proof_sha256": proofs, "folded_root": folded,
                         "verified": [f == root.decode() for f in folded]})

    kind = dict(tier.dtypes)["doc_id"]
    cols = tier.select("grp", "part", "levels", "slot", "doc_id", "value", "changed")
    out = cols.groupBy("grp", "part").cogroup(above.groupBy("grp", "part")).applyInArrow(
        fold, f"doc_id {kind}, grp string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.select("doc_id", F.when(F.col("grp") != "", F.expr("substr(grp, 2)")).alias("source"), "leaf", "subroot", "root",
                      "proof_sha256", "folded_root", "verified")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir)).drop("source")


# ------------------------------------------------------------------ oracle
_CRC = ("list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::bigint)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))")


def _level_sql(name: str, below: str, group: str) -> str:
    """The next level of a table (group, idx, h): while a group has several nodes, runs of 16 become their H; else as it is."""
    return f"""{name} AS (SELECT {group}, CASE WHEN n > 1 THEN idx // 16 ELSE idx END AS idx,
  CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {below}) GROUP BY {group}, n, CASE WHEN n > 1 THEN idx // 16 ELSE idx END)"""


def _siblings_sql(level: str, group: str, alias: str) -> str:
    """All digests of the runs of a level: (group, run, hs) with the number of nodes of the group."""
    return f"""{alias} AS (SELECT {group}, idx // 16 AS run, list(h ORDER BY idx) AS hs, any_value(n) AS n
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {level}) GROUP BY {group}, idx // 16)"""


def oracle(levels: int = 5, tops: int = 3) -> str:
    """DuckDB SQL for up to 16 ** levels rows a source and 16 ** tops sources."""
    f = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::varchar)::varchar || ':' || {c}::varchar END"
    lower = f"CASE WHEN text IS NULL THEN '-' ELSE strlen(text)::varchar || ':' || translate(text, '{UPPER}', '{LOWER}') END"
    head = " || ".join(f(c) for c in FIELDS[:-1])
    crc = _CRC.format("(doc_id::varchar)")
    parts = [f"""s0 AS (SELECT g, doc_id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, h, changed FROM (
  SELECT coalesce('=' || source, '') AS g, doc_id, sha256({head} || {f('text')}) AS h,
    CASE WHEN xor({crc}, 4294967295) % {TAMPER} = 0 THEN sha256({head} || {lower}) END AS changed FROM documents))"""]
    below = "s0"
    for k in range(1, levels + 1):
        parts += [_siblings_sql(below, "g", f"r{k}"), _level_sql(f"s{k}", below, "g")]
        below = f"s{k}"
    parts.append(f"t0 AS (SELECT 1 AS u, row_number() OVER (ORDER BY g) - 1 AS idx, g, h FROM {below})")
    below = "t0"
    for k in range(1, tops + 1):
        parts += [_siblings_sql(below, "u", f"q{k}"), _level_sql(f"t{k}", below, "u")]
        below = f"t{k}"
    # Going up, one level a step: the proof so far, the folded value, the place in the level.
    parts.append("w0 AS (SELECT g, doc_id, h AS leaf, idx, coalesce(changed, h) AS v, '' AS proof FROM s0)")
    prev = "w0"

    def step(name, prev, runs, on):
        slot = "w.idx % 16 + 1"
        left, right = f"array_to_string(hs[1:{slot} - 1], '')", f"array_to_string(hs[{slot} + 1:], '')"
        return f"""{name} AS (SELECT w.* EXCLUDE (idx, v, proof), CASE WHEN n > 1 THEN w.idx // 16 ELSE w.idx END AS idx,
  CASE WHEN n > 1 THEN sha256({left} || w.v || {right}) ELSE w.v END AS v,
  CASE WHEN n > 1 THEN w.proof || {left} || {right} ELSE w.proof END AS proof
  FROM {prev} w JOIN {runs} r ON {on} AND r.run = w.idx // 16)"""

    for k in range(1, levels + 1):
        parts.append(step(f"w{k}", prev, f"r{k}", "r.g = w.g"))
        prev = f"w{k}"
    parts.append(f"x0 AS (SELECT w.* EXCLUDE (idx), t0.idx, t0.h AS subroot FROM {prev} w JOIN t0 ON t0.g = w.g)")
    prev = "x0"
    for k in range(1, tops + 1):
        parts.append(step(f"x{k}", prev, f"q{k}", "true"))
        prev = f"x{k}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, v AS folded_root, v = t.h AS verified
FROM {prev} CROSS JOIN {below} t"""


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": oracle()}
