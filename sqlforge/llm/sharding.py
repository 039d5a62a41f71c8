"""Uniform sharding by a hypergeometric communication matrix (operator 1), all in DataFrame functions.

A uniform random permutation of all rows, cut into shards of fixed sizes, sends a random number of each
partition's rows to each shard. That matrix of counts is drawn first, from its exact law; then

1. each partition permutes its rows and numbers them (a local sort, no exchange);
2. the numbers are cut by the partition's row of the matrix, which gives each row its shard;
3. the rows are exchanged once, to small pieces of shards;
4. each piece permutes again, which gives the gapless slots.

Shard sizes are exact by construction: they differ by one row at most (the ``rows`` law).

The matrix. Given the shard sizes, the counts of half of the partitions are multivariate
hypergeometric, and so are those of each half's halves. The partitions are halved level by level; a
node holds its partitions' sizes and the room it has in each shard. A draw is a chain of
hypergeometric numbers, one per shard, each by inversion: relative weights follow from the most likely
value by the ratio of neighbours, over 10 standard deviations and 20 more (what lies beyond is below
the precision of a double). Random numbers are hashes of (seed, node, shard), so a rerun of a lost
task draws the same. Work and memory grow with partitions times shards, not with rows.

Defined results: any column may be null; equal rows are placed apart from one another; with fewer
rows than shards the first shards get one row each; an empty table gives an empty result; input columns
named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, whole_text

SHARDS = 40
SEED = 1
PIECE_ROWS = 1 << 14     # rows of a piece of a shard that one window orders
_LOW = (1 << 33) - 1     # monotonically_increasing_id: partition above, row below


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _uniform(*parts: Column) -> Column:
    """In (0, 1), 53 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _steps(n: Column) -> Column:
    """1 to n, empty for 0."""
    return F.slice(F.sequence(F.lit(1).cast("long"), n + 1), F.lit(1), n.cast("int"))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items taken out of ``total`` are among the ``good`` ones, for a uniform u."""
    t, g, n = (x.cast("double") for x in (total, good, drawn))
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - good)), F.least(drawn, good)
    mode = F.greatest(low, F.least(high, F.floor((n + 1) * (g + 1) / (t + 2)).cast("long")))
    spread = F.sqrt(F.greatest(F.lit(0.0), n * g / t * (1 - g / t) * (t - n) / F.greatest(t - 1, F.lit(1.0))))
    reach = (F.ceil(spread * 10) + 20).cast("long")
    given = F.struct(total.alias("t"), good.alias("g"), drawn.alias("n"), mode.alias("m"),
                     F.least(reach, high - mode).alias("up"), F.least(reach, mode - low).alias("down"), u.alias("u"))

    def ratio_up(v: Column, k: Column) -> Column:      # weight of k over weight of k - 1
        k = k.cast("double")
        return (v["g"] - k + 1) * (v["n"] - k + 1) / (k * (v["t"] - v["g"] - v["n"] + k))

    def mass(v: Column, n: str, factor: Callable[[Column], Column]) -> Column:
        one = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
        return F.aggregate(_steps(v[n]), one, lambda a, i: _let(a["w"] * factor(i), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"))),
                           lambda a: a["s"])

    def search(v: Column, n: str, factor: Callable[[Column], Column], sign: int, target: Column) -> Column:
        """The value at which the running weight passes the target, null if none does."""
        none = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(None).cast("long").alias("k"))

        def step(a: Column, i: Column) -> Column:
            return _let(a["w"] * factor(i), lambda w: F.struct(
                w.alias("w"), (a["s"] + w).alias("s"),
                F.coalesce(a["k"], F.when(a["s"] + w >= target, v["m"] + i * sign)).alias("k")))
        return F.aggregate(_steps(v[n]), none, step, lambda a: a["k"])

    def draw(v: Column) -> Column:
        up = lambda i: ratio_up(v, v["m"] + i)              # noqa: E731
        down = lambda i: 1 / ratio_up(v, v["m"] - i + 1)
        return _let(F.struct(mass(v, "up", up).alias("a"), mass(v, "down", down).alias("b")), lambda s: _let(
            v["u"] * (1 + s["a"] + s["b"]), lambda x: F.when(x <= 1, v["m"]).when(
                x <= 1 + s["a"], F.coalesce(search(v, "up", up, 1, x - 1), v["m"] + v["up"])).otherwise(
                F.coalesce(search(v, "down", down, -1, x - 1 - s["a"]), v["m"] - v["down"]))))

    return F.when(low >= high, high).otherwise(_let(given, draw))


def _taken(room: Column, drawn: Column, node: Column, seed: int) -> Column:
    """Multivariate hypergeometric: how many of ``drawn`` rows take room in each shard."""
    start = F.struct(drawn.alias("n"), F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x).alias("t"),
                     F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, g: Column) -> Column:
        u = _uniform(F.lit(seed), node, F.size(a["out"]))
        return _let(hypergeometric(a["t"], g, a["n"], u),
                    lambda k: F.struct((a["n"] - k).alias("n"), (a["t"] - g).alias("t"), F.concat(a["out"], F.array(k)).alias("out")))

    return F.aggregate(room, start, step, lambda a: a["out"])


def communication_matrix(sizes: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(part, counts) from sizes (part, n): rows that each partition sends to each shard.

    ``sizes`` has one row per partition, and they start in one row.
    """
    parts = sizes.count()
    leaves = F.array_sort(F.collect_list(F.struct("part", F.col("n").cast("long").alias("n"))))
    rows = F.aggregate("leaves", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.floor(rows / shards).cast("long") + (i < rows % shards).cast("long"))
    nodes = sizes.agg(leaves.alias("leaves")).select(F.lit(1).cast("long").alias("id"), "leaves", room.alias("room"))
    for level in range(max(0, parts - 1).bit_length()):
        half = F.ceil(F.size("leaves") / 2).cast("int")
        left = F.slice("leaves", F.lit(1), half)
        right = F.slice("leaves", half + 1, F.size("leaves"))
        taken = _taken(F.col("room"), F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.col("id"), seed)
        split = _let(taken, lambda k: F.array(
            F.struct((F.col("id") * 2).alias("id"), left.alias("leaves"), k.alias("room")),
            F.struct((F.col("id") * 2 + 1).alias("id"), right.alias("leaves"), F.zip_with("room", k, lambda a, b: a - b).alias("room"))))
        whole = F.array(F.struct("id", "leaves", "room"))
        nodes = nodes.select(F.explode(F.when(F.size("leaves") > 1, split).otherwise(whole)).alias("v")).select("v.*")
        if level == 6:
            nodes = nodes.repartition("id")
    return nodes.filter(F.size("leaves") == 1).select(F.col("leaves")[0]["part"].alias("part"), F.col("room").alias("counts"))


def shard_rows(df: DataFrame, shards: int = SHARDS, seed: int = SEED, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """All columns with shard (0 to shards - 1) and slot (gapless from 0 in each shard), uniformly at random."""
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    own = F.col("_id")
    tagged = materialize(df.select(*keep).withColumn("_u", F.rand(seed)).sortWithinPartitions("_u").drop("_u")
                         .withColumn("_id", F.monotonically_increasing_id()), "shard-rows")
    placed = tagged.withColumn("part", F.shiftright(own, 33)).withColumn("_pos", own.bitwiseAND(F.lit(_LOW)))
    sizes = materialize(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "shard-sizes")
    # Running sums by slices; a row of the matrix has one number per shard.
    ends = F.transform("counts", lambda _, i: F.aggregate(F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    matrix = materialize(communication_matrix(sizes, shards, seed).select("part", ends.alias("_ends")), "shard-matrix")
    pieces = F.lit(max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // (shards * piece_rows))))
    # The second permutation orders by a hash of the row's place, which no two rows share.
    order = F.xxhash64(F.lit(seed + 1), own)
    rows = placed.join(matrix, "part") \
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_pos"))).cast("int")) \
        .withColumn("_order", order) \
        .withColumn("_piece", F.floor((F.shiftrightunsigned("_order", 11).cast("double") / F.lit(float(1 << 53))) * pieces)) \
        .drop("part", "_pos", "_ends")
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(rows.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
                         .select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "shard-pieces")
    inside = Window.partitionBy("shard", "_piece").orderBy(F.shiftrightunsigned("_order", 11), "_order", "_id")
    return rows.withColumn("_rank", F.row_number().over(inside)).join(starts, ["shard", "_piece"]) \
        .withColumn("slot", (F.col("_start") + F.col("_rank") - 1).cast("long")) \
        .select(*keep, "shard", "slot")


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(documents(spark, sf_dir).select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    return rows.select("doc_id", size.alias("size"), F.crc32(whole_text()).cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
                       "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_hypergeometric_shards": op1_hypergeometric_shards}
ORACLES: dict[str, str] = {}
