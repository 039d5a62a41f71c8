"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); the root is the smallest node of the component.

    Each half round points the neighbours of a node to the smallest of them; it ends when nothing
    changes, after a number of rounds that grows with the logarithm of the longest chain. A node
    with many links is never gathered: its smallest neighbour is an aggregate, and its links meet that
    one row in a join that Spark may split. Each round is written to the shared folder.
    """
    edges = materialize(links.filter("a <> b").distinct(), "links")
    last = None
    for _ in range(MOST_ROUNDS):
        edges = materialize(_small(_large(edges)), "links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("links did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.unionByName(roots)


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")) \
        .select("e.a", "e.b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                                            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return linked.select("e.a", "e.b").filter("a <> b").distinct()
