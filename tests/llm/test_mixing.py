"""Operator 8: targets by repeated resharing, takes by a plain sort."""
import math

import pytest
from helpers import SF_SMALL, SPACE, awkward, awkward_rows, empty, prose
from pyspark.sql import functions as F

from sqlforge.llm import mixing as M


def reshared(sizes, weights, share, most):
    """Targets by the contract's words: excess above the limit goes to the others by weight until none is above."""
    total, fixed = share * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        level = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if level[i] > most * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, level.get(i)) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def run(df, bucket_rows=M.BUCKET_ROWS):
    rows = M.keyed(df).cache()
    return M.mix(rows, M.plan_mix(rows, bucket_rows=bucket_rows))


@pytest.mark.parametrize("bucket_rows", [2, 4096])
def test_awkward_documents(spark, bucket_rows):
    df = awkward(spark, clash=("size", "TAKEN", "_key", "target"))
    got = run(df, bucket_rows).collect()
    assert len(got) == len(awkward_rows())
    sources = sorted({r[3] for r in awkward_rows()}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(SPACE.findall(r[1] or "")) for r in awkward_rows() if r[3] == s) for s in sources}
    want = reshared([size[s] for s in sources], [(5, 2, 1)[k % 3] for k in range(len(sources))], 1.5, 2.0)
    for s, t in zip(sources, want):
        own = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(t) and r.source_size == size[s] for r in own)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
        # Rows that are alike share what is left at the boundary, rounded down.
        assert abs(sum(r["taken"] for r in own) - t) <= 3
    for r in got:
        assert r["size"] == len(SPACE.findall(r.text or ""))


def test_prefix_in_key_order(spark):
    df = spark.range(0, 700).selectExpr("id doc_id", "concat_ws(' ', sequence(1, 1 + id % 9)) text", "if(id < 500, 'hot', 'cold') source")
    rows = M.keyed(df).cache()
    got = {r.doc_id: r for r in M.mix(rows, M.plan_mix(rows, bucket_rows=32)).collect()}
    for s in ("hot", "cold"):
        own = sorted((r for r in rows.collect() if r.source == s), key=lambda r: (r._key, r._tie))
        total = sum(r["size"] for r in own)
        target = got[own[0].doc_id].target
        epochs = math.floor(target / total)
        left = round(target) - epochs * total
        for r in own:
            part = min(r["size"], left)
            assert got[r.doc_id].taken == epochs * r["size"] + part
            left -= part


def test_reruns_agree(spark):
    df = awkward(spark)
    order = ["doc_id", "text", "taken"]
    assert sorted(map(str, run(df).select(order).collect())) == sorted(map(str, run(df.repartition(5)).select(order).collect()))


def test_mixed_documents(spark):
    df = awkward(spark)
    plan = {(r.doc_id, r.text): r["taken"] for r in run(df).collect()}
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        assert r.n_chars == len(r.text) or r.n_chars is not None
        key = next(k for k in plan if k[0] == r.doc_id and (k[1] or "").startswith(r.text))
        words[key] = words.get(key, 0) + len(SPACE.findall(r.text))
    alike = {k: sum(1 for r in awkward_rows() if (r[0], r[1]) == k) for k in plan}
    assert words == {k: v * alike[k] for k, v in plan.items() if v}


def test_weights_favour_quality(spark):
    df = spark.range(0, 4000).selectExpr("id doc_id", "if(id % 2 = 0, 'one two three four', '11 22 33 44') text", "'s' source").union(
        spark.range(4000, 20000).selectExpr("id doc_id", "'a b c d' text", "'t' source"))
    rows = M.keyed(df).cache()
    got = M.mix(rows, M.plan_mix(rows, weights=(1, 3), share=0.4)).filter("source = 's'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("t"))
    t = {r.odd: r.t for r in got.collect()}
    assert t[0] > 1.2 * t[1] > 0


def test_empty(spark):
    assert run(empty(spark)).count() == 0 and M.mixed_documents(empty(spark)).count() == 0
    only = awkward(spark).filter("doc_id in (4, 5, 6)")
    assert {r["taken"] for r in run(only).collect()} == {0}


def test_a_target_that_rounds_to_a_whole_epoch_takes_it(spark):
    """Sources of 4 and 3 words: the first's target is 7.5 words, 8 when rounded, two epochs."""
    import duckdb
    rows = [(1, "a b", "one"), (2, "c d", "one"), (3, "e f g", "two")]
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in run(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert got == {r[0]: r[1:] for r in con.execute(M.ORACLE).fetchall()}
    assert got[1][3] + got[2][3] == 8


def weights(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.q for r in df.select("k", M.quality_weight(M.n_words("text"), M.whole_text("text")).alias("q")).orderBy("k").collect()]


def test_quality_weights_spread_and_know_no_script(spark):
    import math
    latin, greek, cyrillic, arabic, chinese = ("word other thing again", "λόγος άλλο πράγμα ξανά", "слово другое снова вещь", "كلمة اخرى شيء مرة", "文字 其他 東西 再次")
    same = weights(spark, [latin, greek, cyrillic, arabic, chinese])
    assert max(same) - min(same) < 1e-12
    plain, marked, repeated, long, none, void = weights(spark, [latin, "wo%d ot&er th*ng ag$in", "word word word word", latin + " " + prose(1, 300), None, " \n"])
    assert void == none == M.LEAST_WEIGHT < repeated < plain < long < 1 and marked < plain
    n, chars, letters = 4, 19, 19
    assert abs(plain - (0.05 + 0.95 * (letters / chars) * (math.log(5) / math.log(5)) * (n / (n + 40)))) < 1e-12
    got = [r.q for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(M.quality_weight(M.n_words("text"), M.whole_text("text")).alias("q")).collect()]
    assert max(got.count(x) for x in set(got)) < len(got) / 3 and max(got) - min(got) > 0.3
