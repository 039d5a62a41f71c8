"""Token features: ids put back from block dictionaries equal a plain look-up; no token is a row of a shuffle."""
import re
from collections import Counter

from pyspark.sql import functions as F

from sqlforge.constants import ALL_TAGS
from sqlforge.operators import tokens as K

TEXTS = [(n, f"ask {n % 7} the <summary> été_{n % 3}", f" SELECT a{n % 5}, the; the </summary>" * (1 + n % 4)) for n in range(40)] + [(99, "p", ""), (100, "", "x")]


def sft(spark):
    df = spark.createDataFrame(TEXTS, "sample_id long, u string, a string").repartition(3)
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), F.col(c).alias("content"))
    return df.select("sample_id", F.lit("sys é").alias("system"), F.array(msg("user", "u"), msg("assistant", "a")).alias("conversations"))


def words(t):
    return re.findall(r"</?(?:clause_[a-z_]+|summary)>|\w+|[^\s\w]", t)


def test_against_a_plain_look_up(spark, monkeypatch):
    monkeypatch.setattr(K, "TOKEN_BLOCK", 4)
    full = {n: f"sys é\n\nUser: {u}\nAssistant:{a}" for n, u, a in TEXTS}
    prompt = {n: f"sys é\n\nUser: {u}\nAssistant:" for n, u, _ in TEXTS}
    counts = Counter(w for t in full.values() for w in words(t) if w not in ALL_TAGS)
    ids = {w: K.FIRST_WORD_ID + k for k, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode())))}
    ids.update({t: K.FIRST_TAG_ID + k for k, t in enumerate(ALL_TAGS)})
    for length in (64, 9):
        got = {r.sample_id: r for r in K.token_features(sft(spark), max_length=length).collect()}
        assert got.keys() == full.keys()
        for n, r in got.items():
            want = ([ids[w] for w in words(full[n])][:length] + [K.EOS_ID])[:length]
            asked = len(words(prompt[n]))
            assert r.prompt_len == asked and r.n_tokens == len(want)
            assert r.input_ids == want + [K.PAD_ID] * (length - len(want))
            assert r.labels == ([K.IGNORE] * min(asked, length) + want[asked:] + [K.IGNORE] * length)[:length]
    some = spark.createDataFrame([("the", 500), ("SELECT", 501)], "token string, id int")
    r = K.token_features(sft(spark), some, 64).filter("sample_id = 1").first()
    assert set(r.input_ids) <= {500, 501, K.PAD_ID, K.EOS_ID, K.UNK_ID, *range(K.FIRST_TAG_ID, K.FIRST_WORD_ID)} and 500 in r.input_ids


def test_blocks_and_dictionaries(spark):
    enc = K.encoded(K.sft_texts(sft(spark)).coalesce(1), 5, 8).collect()
    dictionaries = {r.blk: r.token for r in enc if r.token}
    texts = [r for r in enc if r.sample_id is not None]
    assert len(dictionaries) == 6 and len(texts) == len(TEXTS) and all(len(r.codes) <= 5 for r in texts)
    full = {n: f"sys é\n\nUser: {u}\nAssistant:{a}" for n, u, a in TEXTS}
    assert all([dictionaries[r.blk][c] for c in r.codes] == words(full[r.sample_id])[:5] for r in texts)
    assert sum(sum(r.n) for r in enc if r.token) == sum(len(words(t)) for t in full.values())


def test_full_texts_are_tokenised_in_two_parts(spark):
    answers = ["", "x", ":a", "<summary>", "/clause_select>", "\u0301e 1", " \n", None, "<clause_where>\nb</clause_where>"]
    df = spark.createDataFrame([(n, "Sys", [("u", "ask <summary"), ("a", a)]) for n, a in enumerate(answers)],
                               "sample_id long, system string, conversations array<struct<role:string,content:string>>")
    texts = K.sft_texts(df)
    got = texts.select(K.full_tokens(texts).alias("a"), K.tokens("full").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and sum(r["a"] is None for r in got) == 1
    enc = K.encoded(texts)
    assert enc.filter("token is null").count() == len(answers) - 1
    assert "Filter" not in enc._jdf.queryExecution().executedPlan().toString()
