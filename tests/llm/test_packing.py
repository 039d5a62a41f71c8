"""Operator 7: the dynamic program against brute force, and every id in one piece."""
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import SF_SMALL, awkward, awkward_rows, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from sqlforge.llm import packing as P
from sqlforge.llm import tokenize as Z

WORD = Z.vocabulary("word_bpe_49k.json")


def cost(cuts, pen, window):
    total, at = 0.0, 0
    for c in cuts:
        n = c - at
        assert 0 < n <= window
        total += pen[c] + (0 if n & (n - 1) == 0 and n >= window >> 2 else window - n)
        at = c
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0.0, 1.0, 5.0])), min_size=1, max_size=11))
def test_least_cost(steps):
    window = 16
    places = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    penalty = np.array([0.0] + [p for _, p in steps])
    pen = dict(zip(places.tolist(), penalty.tolist()))
    best = {0: 0.0}
    for j in range(1, len(places)):
        best[j] = min(best[i] + pen[places[j]] + (0 if (n := int(places[j] - places[i])) & (n - 1) == 0 and n >= window >> 2 else window - n)
                      for i in range(j) if places[j] - places[i] <= window)
    cuts = P.window_cuts(places, penalty, window)
    assert cuts[-1] == places[-1] and cost(cuts, pen, window) == pytest.approx(best[len(places) - 1])


def check(rows, ids, window):
    """Each id in one piece, sequences gapless and within the window; the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, want in ids.items():
        at = 0
        for r in sorted(pieces.pop(doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(want[at:at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    pad = total = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
        total += at
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad / max(1, total)


def ids_of(rows):
    t = Z.load_tokenizer(WORD)
    return {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for d, x in rows}


@pytest.mark.parametrize("window,stretch", [(64, 256), (256, 5000), (4096, 1 << 20)])
def test_awkward_documents(spark, window, stretch):
    rows = P.pack(awkward(spark, clash=("offset", "length")), WORD, 2, window, stretch).collect()
    unique = {r[0]: r[1] for r in awkward_rows() if r[0] not in (None, 8)}
    n = sum(len(v) for v in ids_of(enumerate(r[1] for r in awkward_rows())).values())
    assert sum(r.length for r in rows) == n
    by_sequence = defaultdict(int)
    for r in rows:
        by_sequence[r.sequence_id] += r.length
    assert max(by_sequence.values()) <= window
    for d, want in ids_of(unique.items()).items():
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) == len(want)
        assert all(r.ids_crc32 == zlib.crc32(want[r.start:r.start + r.length].tobytes()) for r in own)


def test_empty(spark):
    assert P.pack(empty(spark), WORD, 2).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert check(P.op7_pack_windows(spark, SF_SMALL).collect(), ids_of((d.doc_id, d.text) for d in docs), P.WINDOW) < 0.03


def test_order_is_kept(spark):
    rows = P.pack(awkward(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]), WORD, 2, 256, 5000).collect()
    flow = [(r.doc_id, r.start) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert flow == sorted(flow)
