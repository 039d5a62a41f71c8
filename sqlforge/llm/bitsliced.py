"""Exact top-k by inner product on a bit-sliced index (operator 2).

Vectors are integers (floor(1024 * x)). A block of up to ``BLOCK_ROWS`` candidates is indexed by bit slices: each
component is cut to its upper ``SLICES`` bits within the block's range, and bit b of component d of all rows is one
bitmap. For a query the slices are multiplied and added with bitmap arithmetic alone: a negative
weight takes the complement of a slice, weights are cut to ``WEIGHT_BITS`` bits, slices of the same
significance are added three at a time by full adders, and the carries move up. The result, again in bit
slices, is a sum S per row; what was cut off is bounded, so S gives a lower and an upper bound of the score.

The k-th largest S is found from the most significant slice downward with population counts; rows whose upper
bound reaches the k-th lower bound (or the k-th exact score that this task has already seen for the query) are the
boundary, taken by one bit-sliced comparison and scored exactly. No row that belongs to the top k can be lost,
so recall is 1.

Scale. Every row is indexed in place, without a shuffle. The query set meets every candidate block: query blocks
are copied to groups of candidate blocks, ``GROUPS_PER_CORE`` for each core of the cluster, and joined on the group, so copies don't grow
with the candidates. A task holds one block of each at a time and leaves at most k rows per query and block. Spark cuts these to k per query before they are exchanged.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of another
length than the query's are no candidates; a query is excluded from its own candidates as a row, so a repeated row
is a candidate of its twin; equal scores go to the smaller vec_id (null last); with fewer than k candidates all are
returned; queries are rows whose vec_id is divisible by 100 (a null id never is). Integers and scores have 64 bits: components
saturate there and scores are defined as long as they fit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

K = 10
SCALE = 1024.0
BLOCK_ROWS = 2048
QUERY_ROWS = 64
GROUPS_PER_CORE = 4   # groups of candidate blocks, each of which gets a copy of the queries
SLICES = 6
WEIGHT_BITS = 8


def pack(rows: np.ndarray) -> np.ndarray:
    """Bitmap (64-bit words) of booleans over the last axis; its length is a multiple of 64."""
    return np.packbits(rows, axis=-1, bitorder="little").view("<u8")


class Slices:
    """Bit-sliced index of a block of integer vectors (n x d)."""

    def __init__(self, v: np.ndarray, slices: int = SLICES):
        self.v, (self.n, self.d) = v, v.shape
        wide = -(-self.n // 64) * 64
        low, high = (v.min(axis=0), v.max(axis=0)) if self.n else (np.zeros(self.d, np.int64),) * 2
        bits = np.array([int(x).bit_length() for x in (high - low)], dtype=np.int64)
        self.shift = np.maximum(bits - slices, 0)
        self.low, self.slices = low, slices
        u = (v - low) >> self.shift
        padded = np.zeros((wide, self.d), dtype=np.int64)
        padded[:self.n] = u
        # (slice, component, word)
        self.maps = np.stack([pack(np.ascontiguousarray((padded >> b & 1).astype(bool).T)) for b in range(slices)]) \
            if self.d else np.zeros((slices, 0, wide // 64), dtype="<u8")
        self.real = pack(np.arange(wide) < self.n)

    def sums(self, w: np.ndarray, weight_bits: int = WEIGHT_BITS):
        """For queries w (q x d): slices of S (list of q x words), base, step and width of the bounds.

        base + step * S <= score <= base + step * S + width.
        """
        q = len(w)
        scaled = np.abs(w) << self.shift                       # weight of a unit of u
        top = scaled.max(axis=1, initial=0)
        t = np.array([max(0, int(x).bit_length() - weight_bits) for x in top], dtype=np.int64)
        a = scaled >> t[:, None]
        rest = scaled - (a << t[:, None])
        full = (1 << self.slices) - 1
        negative = w < 0
        cut = (np.int64(1) << self.shift) - 1                  # most that the lower bits of a component hold
        below = np.where(negative, w * cut, 0).sum(axis=1)
        above = np.where(negative, 0, w * cut).sum(axis=1)
        base = (w * self.low).sum(axis=1) - np.where(negative, scaled * full, 0).sum(axis=1) + below
        width = (rest * full).sum(axis=1) + above - below
        flip = np.where(negative, ~np.uint64(0), np.uint64(0))                       # q x d
        levels, carries, p = [], [], 0
        while p < self.slices + weight_bits - 1 or carries:
            terms = carries
            for b in range(self.slices):
                j = p - b
                if 0 <= j < weight_bits:
                    on = a >> j & 1
                    dims = np.flatnonzero(on.any(axis=0))
                    if len(dims):
                        mask = np.where(on[:, dims] == 1, ~np.uint64(0), np.uint64(0)).T[:, :, None]
                        terms.append((self.maps[b, dims][:, None, :] ^ flip[:, dims].T[:, :, None]) & mask)
            level, carries = self._add(terms, q)
            levels.append(level)
            p += 1
        return levels, base, np.int64(1) << t, width

    def _add(self, terms: list, q: int):
        """Add bitmaps of one significance: their sum's bit, and the carries as bitmaps of the next."""
        x = np.concatenate(terms) if terms else np.zeros((0, q, self.maps.shape[2]), dtype="<u8")
        carries = []
        while len(x) > 1:
            third = len(x) // 3
            if third:
                a, b, c, rest = x[:third], x[third:2 * third], x[2 * third:3 * third], x[3 * third:]
                ab = a ^ b
                carries.append((a & b) | (c & ab))
                x = np.concatenate([ab ^ c, rest])
            else:
                carries.append((x[:1] & x[1:2]))
                x = x[:1] ^ x[1:2]
        level = x[0] if len(x) else np.zeros((q, self.maps.shape[2]), dtype="<u8")
        return level, carries

    def kth(self, levels: list, k: int, q: int) -> np.ndarray:
        """k-th largest S of each query (0 if there are fewer rows), from the most significant slice down."""
        sure = np.zeros(q, dtype=np.int64)                     # rows known to be above
        tied = np.broadcast_to(self.real, (q, len(self.real))).copy()
        value = np.zeros(q, dtype=np.int64)
        for p in range(len(levels) - 1, -1, -1):
            ones = tied & levels[p]
            n = np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
            enough = sure + n >= k
            tied = np.where(enough[:, None], ones, tied & ~levels[p])
            sure = np.where(enough, sure, sure + n)
            value |= np.where(enough, np.int64(1) << p, 0)
        return value if self.n >= k else np.zeros(q, dtype=np.int64)

    def at_least(self, levels: list, bound: np.ndarray) -> np.ndarray:
        """Bitmaps of the rows with S >= bound."""
        above = np.zeros((len(bound), len(self.real)), dtype="<u8")
        equal = np.broadcast_to(self.real, above.shape).copy()
        over = bound >= np.int64(1) << len(levels)
        for p in range(len(levels) - 1, -1, -1):
            bit = (bound >> p & 1 == 1)[:, None]
            above = np.where(bit, above, above | (equal & levels[p]))
            equal = np.where(bit, equal & levels[p], equal & ~levels[p])
        return np.where(over[:, None], np.uint64(0), above | equal)

    def top(self, w: np.ndarray, k: int, known: np.ndarray | None = None):
        """(query, row, score) of all rows that can be among the k best; ``known``: scores already reached k times."""
        if not self.n or not len(w):
            return (np.zeros(0, np.int64),) * 3
        levels, base, step, width = self.sums(w)
        least = base + step * self.kth(levels, k, len(w))
        if self.n < k:
            least[:] = np.iinfo(np.int64).min // 4
        if known is not None:
            least = np.maximum(least, known)
        bound = np.maximum(0, -((base + width - least) // step))     # upper bound >= least
        rows = np.unpackbits(np.ascontiguousarray(self.at_least(levels, bound)).view(np.uint8), axis=1, bitorder="little")[:, :self.n]
        q, r = np.nonzero(rows)
        score = np.empty(len(q), dtype=np.int64)
        for s in range(0, len(q), 1 << 16):
            score[s:s + (1 << 16)] = (w[q[s:s + (1 << 16)]] * self.v[r[s:s + (1 << 16)]]).sum(axis=1)
        return q, r, score


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, _row, dim and v (integers) of the vectors that take part, written once."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    rows = vectors.filter(x.isNotNull() & finite) \
        .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("v"))
    return materialize(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a partition in blocks of at most ``size`` vectors of one length: dim, n, ids, rows, v (bytes)."""
    def run(batches):
        import pyarrow as pa
        held: dict[int, list] = {}

        def out(dim):
            got = held.pop(dim)
            ids = pa.array([[g[0] for g in got]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), ids, pa.array([[g[1] for g in got]], pa.list_(pa.int64())),
                                               pa.array([np.array([g[2] for g in got], dtype=np.int64).tobytes()], pa.binary())],
                                              names=["dim", "ids", "rows", "v"])
        for b in batches:
            for i, r, v in zip(b.column("id").to_pylist(), b.column("_row").to_pylist(), b.column("v").to_pylist()):
                held.setdefault(len(v), []).append((i, r, v))
                if len(held[len(v)]) >= size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.select("id", "_row", "v").mapInArrow(run, "dim int, ids array<bigint>, rows array<bigint>, v binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows ``queries`` of ``vectors`` (both from ``valid``)."""
    cands = materialize(blocked(vectors, BLOCK_ROWS).withColumn("_block", F.monotonically_increasing_id()), "slices")
    asked = max(1, -(-queries.count() // QUERY_ROWS))
    # A group has many candidate blocks: queries are copied once per group, a few groups a core, whatever the number of blocks.
    groups = max(1, min(cands.count(), GROUPS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism))
    asks = materialize(blocked(queries.repartition(asked), QUERY_ROWS), "queries")
    dealt = asks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "dim", F.col("ids").alias("q_ids"),
                        F.col("rows").alias("q_rows"), F.col("v").alias("q_v"))
    pairs = cands.withColumn("g", F.pmod(F.xxhash64("_block"), F.lit(groups)).cast("int")).join(dealt, ["g", "dim"]).drop("g", "_block")

    def run(batches):
        import pyarrow as pa
        have, index, seen = None, None, {}
        for b in batches:
            for r in b.to_pylist():
                ids, rows, d = np.array([0 if x is None else x for x in r["ids"]]), np.array(r["rows"]), r["dim"]
                if have != (rows[0], len(rows), d):
                    have, index = (rows[0], len(rows), d), Slices(np.frombuffer(r["v"], dtype=np.int64).reshape(len(rows), d))
                    null = np.array([x is None for x in r["ids"]])
                q_rows = r["q_rows"]
                w = np.frombuffer(r["q_v"], dtype=np.int64).reshape(len(q_rows), d)
                known = np.array([seen.get(x, np.iinfo(np.int64).min // 4) for x in q_rows], dtype=np.int64)
                # One more than k: a query's own row may be among them.
                q, c, score = index.top(w, k + 1, known)
                other = rows[c] != np.array(q_rows, dtype=np.int64)[q]
                q, c, score = q[other], c[other], score[other]
                order = np.lexsort((rows[c], ids[c], null[c], -score, q))
                q, c, score = q[order], c[order], score[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                best = place < k
                for i, s in zip(q[place == k - 1].tolist(), score[place == k - 1].tolist()):
                    seen[q_rows[i]] = max(seen.get(q_rows[i], s), s)
                if len(seen) > 1_000_000:
                    seen.clear()
                q, c, score = q[best], c[best], score[best]
                yield pa.RecordBatch.from_arrays([pa.array([r["q_ids"][i] for i in q.tolist()], pa.int64()), pa.array([q_rows[i] for i in q.tolist()], pa.int64()),
                                                  pa.array([r["ids"][i] for i in c.tolist()], pa.int64()), pa.array(rows[c]), pa.array(score)],
                                                 names=["query_id", "q_row", "vec_id", "row", "score"])

    found = pairs.mapInArrow(run, "query_id long, q_row long, vec_id long, row long, score long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op2_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.filter(F.pmod("id", F.lit(100)) == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024.0)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
QUERIES = {"op2_bitsliced_topk": op2_bitsliced_topk}
ORACLES = {"op2_bitsliced_topk": ORACLE}
