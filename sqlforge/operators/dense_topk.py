"""Exact top-k by cosine over dense vectors, with blocks left out by angle bounds.

Queries and items of a group are cut into blocks of about ``BLOCK`` rows. Rows share a block if they lie on the same
sides of some fixed directions (as many as the group has blocks for, ``SIDES`` at most), so a block covers a
small range of angles; larger cells are cut by further directions, and by a hash where these do not part them. A block has a pivot, the
direction of its mean, and a radius, its
largest angle to the pivot. By the triangle inequality no pair of a query block and an item block has an
angle under ``angle(pivots) - radius - radius``; the cosine of that bounds the pair. Queries of a block with the same vector are
one row of its matrix: scored once.

1. Every query block is scored with its best-bounded item blocks, of ``BLOCK`` rows together. The k-th values found are floors.
2. Of the other pairs only those whose bound reaches the lowest floor of the query block are scored, best-bounded first, and in these only
   the queries whose own angle to the item block's pivot lets it reach their floor. Below its floor a query gives nothing back.
3. What the teams found for a query block is merged in one task and given to the queries of each row. Rows of one id share its k places.

Pairs of blocks meet as rows of pivots (a few hundred bytes), dealt by group and a salt of the query block. Vectors travel
once per team: query blocks and item blocks of about ``TEAM`` times ``BLOCK`` rows of a group form a task group, so a query block is copied
as often as the group has teams of item blocks, and no task holds more than a team's blocks. Only the k best of a query leave it,
as arrays of the block: merging holds k values per query of one block and team of items at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SIM_SCALE
from ..session import materialize

BLOCK = 1024      # rows of a block, about
SIDES = 12        # directions that a group is cut by at most
FINER = 2         # directions beyond those that cut a group to blocks of the size
TEAM = 8          # full blocks that a team has the rows of, about
SALTS = 16        # keys that the pairs of pivots of one group are dealt to
RUN = 32          # columns of which one maximum is taken
SLACK = 1e-7      # what rounding may add to a bound
EQUAL = 2e-9      # values that differ by less may be equal after rounding to SIM_SCALE digits


def directions(dim: int) -> np.ndarray:
    """The fixed directions for vectors of a dimension."""
    return np.random.default_rng(dim).normal(size=(SIDES, dim))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows without a direction (zero or not finite) are 0, so their cosines are."""
    with np.errstate(all="ignore"):
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
    u[~np.isfinite(u).all(axis=1)] = 0.0
    return u


def _cells(df: DataFrame) -> DataFrame:
    """(g, id, vec as bytes of unit rows, cell): the sides of all ``SIDES`` directions as bits."""
    def run(batches):
        for b in batches:
            u = unit(_matrix(b.column("vec")))
            bits = (u @ directions(u.shape[1]).T > 0) if len(u) else np.zeros((0, SIDES), bool)
            cell = bits @ (1 << np.arange(SIDES)[::-1])
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("id"), pa.array([r.tobytes() for r in u], pa.binary()), pa.array(cell, pa.int32())],
                                             names=["g", "id", "vec", "cell"])

    rows = df.filter(F.col("vec").isNotNull()).select("g", F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "g long, id long, vec binary, cell int")


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """(g, blk, ids, at, vecs, pivot, radius, team): one row per block, its different vectors one after another, ``at`` the place of each id's."""
    cells = materialize(_cells(df), f"dense-{name}")
    per = cells.groupBy("g").agg(F.ceil(F.log2(F.count(F.lit(1)) / size)).cast("int").alias("_bits"))
    # Finer than the size asks for: rows that do lie together then get blocks of their own.
    bits = F.least(F.greatest(F.col("_bits") + FINER, F.lit(0)), F.lit(SIDES))
    cut = cells.join(per.select("g", bits.alias("_bits")), "g")
    coarse = F.floor(F.col("cell") / F.pow(F.lit(2.0), F.lit(SIDES) - F.col("_bits"))).cast("long")
    cut = cut.withColumn("_coarse", coarse)
    # A cell of more rows than a block has takes further directions. Cells stay apart: within one all have the same number.
    more = cut.groupBy("g", "_coarse", "_bits").agg(F.count(F.lit(1)).alias("_n")) \
        .select("g", "_coarse", F.least(F.col("_bits") + F.greatest(F.ceil(F.log2(F.col("_n") / size)), F.lit(0)), F.lit(SIDES)).cast("int").alias("_deep"))
    step = F.pow(F.lit(2.0), F.lit(SIDES) - F.col("_deep"))
    cut = cut.join(more, ["g", "_coarse"]).withColumn("cell", (F.floor(F.col("cell") / step) * step).cast("long")).drop("_bits", "_coarse", "_deep")
    sizes = cut.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("_subs"))
    placed = cut.join(sizes, ["g", "cell"]).withColumn("blk", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("_subs")))

    def gather(key, table):
        vecs = table.column("vec").to_pylist()
        places = {}
        at = [places.setdefault(v, len(places)) for v in vecs]
        u = np.frombuffer(b"".join(places), np.float64).reshape(len(places), -1)
        mean = unit(u.mean(axis=0, keepdims=True))[0]
        has = np.abs(u).sum(axis=1) > 0
        # A row or a mean without a direction: no bound.
        radius = float(np.arccos(np.clip(u @ mean, -1, 1)).max()) if has.all() and np.abs(mean).sum() > 0 else math.pi
        return pa.table({"g": [key[0].as_py()], "blk": [key[1].as_py()], "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())), "at": pa.array([at], pa.list_(pa.int32())),
                         "vecs": pa.array([u.tobytes()], pa.binary()), "pivot": pa.array([mean.tolist()], pa.list_(pa.float64())), "radius": [radius]})

    blocks = placed.select("g", "blk", "id", "vec").groupBy("g", "blk") \
        .applyInArrow(gather, "g long, blk long, ids array<bigint>, at array<int>, vecs binary, pivot array<double>, radius double")
    blocks = materialize(blocks, f"dense-{name}-blocks")
    teams = blocks.groupBy("g").agg(F.ceil(F.sum(F.size("ids")) / (TEAM * size)).alias("_teams"))
    return blocks.join(teams, "g").withColumn("team", F.pmod(F.xxhash64("blk"), F.col("_teams")).cast("int")).drop("_teams")


def best_of_pair(q: np.ndarray, h: np.ndarray, hi: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, ids and rounded cosines of the k best rows of h for each row of q, ties to the smaller id.

    ``floor`` has a value for each row of q; what is below it may be left out. Cosines are neither sorted nor rounded but for the few
    at or above a bound: the floor, or the k-th of the maxima of ``RUN`` columns each, which k cosines at least reach.
    """
    s = q @ h.T
    least = np.full(len(q), -np.inf) if floor is None else floor
    if len(hi) >= RUN * k and not np.isfinite(least).all():
        runs = np.maximum.reduceat(s, np.arange(0, len(hi), RUN), axis=1)
        least = np.maximum(least, np.partition(runs, -k, axis=1)[:, -k])
    r, c = np.divmod(np.flatnonzero(s >= (least - EQUAL)[:, None]), len(hi))
    v = np.round(s[r, c], SIM_SCALE) + 0.0
    order = np.lexsort((hi[c], -v, r))
    r, c, v = r[order], c[order], v[order]
    best = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[best], hi[c[best]], v[best]


def _leading(r: np.ndarray, h: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row r by value, ties to the smaller id, in the order of rows."""
    order = np.lexsort((h, -s, r))
    r, h, s = r[order], h[order], s[order]
    best = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[best], h[best], s[best]


def _kth(r: np.ndarray, s: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th value of each of n rows, of values in the order of :func:`_leading`; -inf for rows with fewer."""
    out = np.full(n, -np.inf)
    last = np.arange(len(r)) - np.searchsorted(r, r) == k - 1
    out[r[last]] = s[last]
    return out


def best_of_blocks(q: np.ndarray, items: list[tuple], k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`best_of_pair` over several blocks (rows, ids) or (rows, ids, pivot, radius); the k-th values so far are the floors of the next.

    With pivot and radius only rows of q are scored whose angle to the pivot lets them reach their floor. What is below ``floor`` may be left out.
    """
    r, h, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    given = np.full(len(q), -np.inf) if floor is None else floor
    floor = given
    for m, hi, *ball in items:
        some = None
        if ball and ball[1] < math.pi:
            angle = np.arccos(np.clip(q @ ball[0], -1, 1)) - ball[1]
            some = np.flatnonzero(np.cos(np.maximum(angle, 0)) >= floor - SLACK)
            some = None if len(some) == len(q) else some
        new = best_of_pair(q, m, hi, k, floor) if some is None else best_of_pair(q[some], m, hi, k, floor[some])
        if not len(new[0]):
            continue
        new = new if some is None else (some[new[0]], *new[1:])
        r, h, s = _leading(*(np.concatenate(x) for x in zip((r, h, s), new)), k)
        floor = np.maximum(given, _kth(r, s, k, len(q)))
    return r, h, s


_FOUND = "g long, qblk long, n int, at array<int>, h array<bigint>, sim array<double>, least double"


def _found(g, qblk, n: int, r: np.ndarray, h: np.ndarray, s: np.ndarray, k: int) -> dict:
    """A row of ``_FOUND``: what is found for a query block of n rows, and the least of their k-th values."""
    least = float(_kth(r, s, k, n).min()) if n else -2.0
    return {"g": g, "qblk": qblk, "n": n, "at": r.astype(np.int32), "h": h, "sim": s, "least": max(least, -2.0)}


def _table(rows: list[dict]) -> pa.Table:
    kinds = {"g": pa.int64(), "qblk": pa.int64(), "n": pa.int32(), "at": pa.list_(pa.int32()), "h": pa.list_(pa.int64()), "sim": pa.list_(pa.float64()), "least": pa.float64()}
    return pa.table({c: pa.array([x[c] for x in rows], kind) for c, kind in kinds.items()})


def _lists(table: pa.Table, *names: str) -> list[np.ndarray]:
    """List columns, each as one array of all rows' values."""
    return [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in names]


def _scored(pairs: DataFrame, qb: DataFrame, hb: DataFrame, k: int, known: DataFrame | None = None) -> DataFrame:
    """``_FOUND`` rows for the wanted pairs (g, qblk, hblk, qteam, hteam, bound): the k best of each query block's rows in each team.

    ``known`` has what was found for the query blocks before (:func:`merged`); the k-th values in it are floors.
    """
    key = ["g", "qteam", "hteam"]
    left = pairs.groupBy(*key, "qblk").agg(F.sort_array(F.collect_list(F.struct("bound", "hblk")), asc=False).alias("with")) \
        .select(*key, "qblk", F.col("with.hblk").alias("with")) \
        .join(qb.select("g", F.col("blk").alias("qblk"), (F.array_max("at") + 1).alias("n"), "vecs"), ["g", "qblk"])
    if known is None:
        left = left.withColumn("kat", F.array().cast("array<int>")).withColumn("ksim", F.array().cast("array<double>"))
    else:
        left = left.join(known.select("g", "qblk", F.col("at").alias("kat"), F.col("sim").alias("ksim")), ["g", "qblk"])
    right = pairs.select(*key, "hblk").distinct().join(hb.select("g", F.col("blk").alias("hblk"), "ids", "at", "vecs", "pivot", "radius"), ["g", "hblk"])
    right = right.select(*(F.col(c).alias(f"_{c}") for c in key), "hblk", "ids", "at", "vecs", "pivot", "radius")      # names of their own for the two sides of one table

    def run(key, queries, items):
        held, out = {}, []
        for blk, ids, at, vecs, pivot, radius in zip(*(items.column(c).to_pylist() for c in ("hblk", "ids", "at", "vecs", "pivot", "radius"))):
            rows = np.frombuffer(vecs, np.float64).reshape(max(at) + 1, -1)
            # Items stay one row each: every one of a vector's ids may be among the best.
            held[blk] = rows if len(rows) == len(ids) else rows[at], np.array(ids, np.int64), np.array(pivot), radius
        for qblk, n, vecs, partners, kat, ksim in zip(*(queries.column(c).to_pylist() for c in ("qblk", "n", "vecs", "with", "kat", "ksim"))):
            floor = _kth(np.array(kat, np.int64), np.array(ksim, np.float64), k, n)
            best = best_of_blocks(np.frombuffer(vecs, np.float64).reshape(n, -1), [held[b] for b in partners], k, floor)
            out.append(_found(key[0].as_py(), qblk, n, *best, k))
        return _table(out)

    # Dealt to a number of tasks of its own: by bytes, which say little about the work, task groups would be put together to a few.
    tasks, names = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), [f"_{c}" for c in key]
    left = left.select(*key, "qblk", "n", "vecs", "with", "kat", "ksim").repartition(tasks, *key)
    return left.groupBy(*key).cogroup(right.repartition(tasks, *names).groupBy(*names)).applyInArrow(run, _FOUND)


def merged(found: DataFrame, k: int) -> DataFrame:
    """``found`` with one row per query block: the k best of all its teams."""
    def run(key, table):
        best = _leading(*_lists(table, "at", "h", "sim"), k)
        return _table([_found(key[0].as_py(), key[1].as_py(), table.column("n")[0].as_py(), *best, k)])

    return found.groupBy("g", "qblk").applyInArrow(run, _FOUND)


def _given(found: DataFrame, qb: DataFrame, k: int) -> DataFrame:
    """(g, q, h, sim): the merged best of a block's rows for all its queries."""
    def run(key, table, blocks):
        if not (table.num_rows and blocks.num_rows):
            return pa.table({c: pa.array([], pa.float64() if c == "sim" else pa.int64()) for c in ("g", "q", "h", "sim")})
        r, h, s = _leading(*_lists(table, "at", "h", "sim"), k)
        ids, at = _lists(blocks, "ids", "at")
        begin, end = np.searchsorted(r, at), np.searchsorted(r, at, side="right")
        n = end - begin
        of = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pa.table({"g": pa.array(np.full(len(of), key[0].as_py(), np.int64)), "q": np.repeat(ids, n), "h": h[of], "sim": s[of]})

    blocks = qb.select(F.col("g").alias("_g"), F.col("blk").alias("_blk"), "ids", "at")
    return found.select("g", "qblk", "at", "h", "sim").groupBy("g", "qblk").cogroup(blocks.groupBy("_g", "_blk")) \
        .applyInArrow(run, "g long, q long, h long, sim double")


def block_pairs(qb: DataFrame, hb: DataFrame) -> DataFrame:
    """(g, qblk, hblk, qteam, hteam, hn, bound) for every query block and item block of a group; hn are the item block's rows."""
    salt = F.pmod(F.xxhash64("blk"), F.lit(SALTS)).cast("int")
    left = qb.select("g", F.col("blk").alias("qblk"), F.col("team").alias("qteam"), F.col("pivot").alias("qp"), F.col("radius").alias("qr"), salt.alias("salt"))
    right = hb.select("g", F.col("blk").alias("hblk"), F.col("team").alias("hteam"), F.col("pivot").alias("hp"), F.col("radius").alias("hr"), F.size("ids").alias("hn"),
                      F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dot = F.aggregate(F.zip_with("qp", "hp", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))) - F.col("qr") - F.col("hr")
    return left.join(right, ["g", "salt"]).select("g", "qblk", "hblk", "qteam", "hteam", "hn", F.cos(F.least(F.greatest(angle, F.lit(0.0)), F.lit(math.pi))).alias("bound"))


def dense_topk(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Best k items of the same group by cosine, ties to the smaller id: (g, q, h, sim, rank).

    ``queries`` and ``items`` are (g, id, vec) with long g and id; vectors of a group have one length. A vector without
    a direction has cosine 0 with all; rows without a vector take no part.
    """
    qb, hb = _blocks(queries, block, "queries"), _blocks(items, block, "items")
    pairs = materialize(block_pairs(qb, hb), "dense-pairs")
    w = Window.partitionBy("g", "qblk").orderBy(F.col("bound").desc(), "hblk")
    # The best-bounded blocks, as many as have the rows of a full one: the best may have few.
    first = pairs.withColumn("_before", F.sum("hn").over(w) - F.col("hn")).filter(F.col("_before") < block).drop("_before")
    found = materialize(merged(_scored(first, qb, hb, k), k), "dense-first")
    others = wanted_pairs(pairs, first, found, qb, k)
    both = _given(found.unionByName(_scored(others, qb, hb, k, found)), qb, k)
    # Rows of one id, in whatever blocks, share its k places.
    w = Window.partitionBy("g", "q").orderBy(F.col("sim").desc(), F.col("h").asc())
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def wanted_pairs(pairs: DataFrame, first: DataFrame, found: DataFrame, qb: DataFrame, k: int) -> DataFrame:
    """The pairs beside the first ones whose bound reaches the k-th value of some query of the block."""
    least = found.groupBy("g", "qblk").agg(F.max("least").alias("least"))
    return pairs.join(first.select("g", "qblk", "hblk"), ["g", "qblk", "hblk"], "left_anti").join(least, ["g", "qblk"]) \
        .filter(F.col("bound") >= F.col("least") - SLACK).drop("least")
