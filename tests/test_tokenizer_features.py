"""Features of a plugged-in tokenizer: cut, padded, masked as row by row; only prompt and answer go to the worker."""
import hashlib
import random

from sqlforge.constants import MAX_LENGTH
from sqlforge.operators import tokens as TK
from sqlforge.plans import queries


def _sft(spark, rows):
    return spark.createDataFrame([(n, "S", [("user", u), ("assistant", a)]) for n, u, a in rows],
                                 "sample_id long, system string, conversations array<struct<role: string, content: string>>")


def _plain(rows, width, eos):
    encode, out = TK.word_length_tokenizer(), {}
    for n, u, a in rows:
        p = f"S\n\nUser: {u}\nAssistant:"
        prompt, full = encode([p, p + a])
        ids = (full + ([eos] if eos is not None else []))[:width]
        k = min(len(prompt), width)
        labels = ([-100] * k + ids[k:])[:width]
        out[n] = (len(prompt), len(ids), ids + [0] * (width - len(ids)), [1] * len(ids) + [0] * (width - len(ids)), labels + [-100] * (width - len(labels)))
    return out


def test_features_as_row_by_row(spark, monkeypatch):
    r = random.Random(5)
    rows = [(n, " ".join("x" * r.randint(1, 9) for _ in range(r.randint(0, 20))), " ".join("y" * r.randint(1, 9) for _ in range(r.choice((0, 1, 3, 30))))) for n in range(200)]
    monkeypatch.setattr(TK, "FEATURES", 300)
    for width, eos in ((12, 1), (40, None), (1, 1)):
        f = TK.tokenizer_features(_sft(spark, rows), TK.word_length_tokenizer, max_length=width, eos_id=eos)
        assert {x.sample_id: tuple(x)[1:] for x in f.collect()} == _plain(rows, width, eos)
    assert TK.tokenizer_features(_sft(spark, []), TK.word_length_tokenizer, max_length=5).count() == 0


def test_the_query_keeps_prompts_and_answers_whole(spark, monkeypatch):
    rows = [(1, "x yy " * 150, "zzz " * 90), (2, "x", "y"), (3, "q " * 5000, "a")]
    monkeypatch.setattr(queries, "_sft", lambda spark, sf: _sft(spark, rows))
    md5 = lambda ids: hashlib.md5(",".join(map(str, ids)).encode()).hexdigest()
    want = {n: (p, k, md5(ids), md5(labels), sum(mask)) for n, (p, k, ids, mask, labels) in _plain(rows, MAX_LENGTH, 1).items()}
    got = {r.sample_id: tuple(r)[1:] for r in queries.q_sft_features_user(spark, "").collect()}
    assert got == want and got[1][1] > got[1][0] > 300


def test_the_prompt_is_sent_once(spark):
    plan = TK.tokenizer_features(_sft(spark, [(1, "u", "a")]), TK.word_length_tokenizer)._jdf.queryExecution().optimizedPlan()
    assert [c.name() for c in _seq(plan.children().head().output())] == ["sample_id", "prompt", "answer"]


def _seq(items):
    return [items.apply(n) for n in range(items.size())]
