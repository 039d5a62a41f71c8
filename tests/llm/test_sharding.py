"""Operator 1: exact shard sizes, gapless slots, the law of the draw."""
from collections import Counter, defaultdict
from math import comb

from helpers import awkward, awkward_rows, empty
from pyspark.sql import functions as F

from sqlforge.llm import sharding as S


def test_hypergeometric_law(spark):
    long = lambda x: F.lit(x).cast("long")
    n = 20000
    got = spark.range(n).select(S.hypergeometric(long(30), long(12), long(10), S._uniform(F.lit(3), F.col("id"))).alias("k")) \
        .groupBy("k").count().collect()
    chi = sum((r["count"] - (e := n * comb(12, r.k) * comb(18, 10 - r.k) / comb(30, 10))) ** 2 / e for r in got)
    assert sum(r["count"] for r in got) == n and chi < 35


def test_degenerate_draws(spark):
    df = spark.createDataFrame([(5, 0, 3, 0.5), (5, 5, 3, 0.5), (5, 2, 0, 0.9), (5, 2, 5, 0.1), (0, 0, 0, 0.1)], "t long, g long, n long, u double")
    assert [r[0] for r in df.select(S.hypergeometric(F.col("t"), F.col("g"), F.col("n"), F.col("u"))).collect()] == [0, 3, 0, 2, 0]


def test_matrix_sums(spark):
    sizes = [0, 1, 17, 300, 5, 1000, 2]
    m = S.communication_matrix(spark.createDataFrame(list(enumerate(sizes)), "part long, n long"), 7).collect()
    rows = {r.part: list(r.counts) for r in m}
    assert {k: sum(v) for k, v in rows.items()} == dict(enumerate(sizes))
    columns = [sum(v[i] for v in rows.values()) for i in range(7)]
    assert max(columns) - min(columns) <= 1 and columns == sorted(columns, reverse=True)


def test_shards_hold_every_row_once(spark):
    df = awkward(spark, clash=("shard", "SLOT"))
    got = S.shard_rows(df, shards=6, piece_rows=4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in awkward_rows())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[k]) for k in range(6)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_empty_and_fewer_rows_than_shards(spark):
    assert S.shard_rows(empty(spark), 5).count() == 0
    got = S.shard_rows(spark.range(3), 5).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0), (2, 0)]


def test_shuffle_is_uniform(spark):
    """A row of the first partition is equally likely in each shard (over seeds)."""
    df = spark.range(0, 40, 1, 4)
    hits = Counter(r.shard for seed in range(12) for r in S.shard_rows(df, 4, seed=seed).filter("id < 10").collect())
    assert sum(hits.values()) == 120 and all(15 <= hits[k] <= 46 for k in range(4))


def test_query(spark):
    import zlib
    from helpers import SF_SMALL
    got = S.op1_hypergeometric_shards(spark, SF_SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert len(got) == len(docs) and {r.shard for r in got} == set(range(40))
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
