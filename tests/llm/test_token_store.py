"""Operator 4 and the tokenizers: exact ids, round trip, format."""
import random
import struct
import uuid
import zlib

import numpy as np
import pytest
import zstandard
from helpers import SF_SMALL, awkward, awkward_rows, empty

from sqlforge.llm import token_store as T
from sqlforge.llm import tokenize as Z
from sqlforge.session import shared_path

BYTE = Z.vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("kind,name", [(Z.SpaceLed, "byte_bpe_50k.json"), (Z.SpaceFree, "word_bpe_49k.json")])
def test_pieces_give_the_ids_of_whole_texts(kind, name, monkeypatch):
    monkeypatch.setattr(Z, "CACHE_PIECES", 50)
    r = random.Random(4)
    parts = list("ab Zé  \n\n\t.,'sİΣσ字́\xa0\x1c\x85ë!?#&1٣_-") + ["I'm ", "don't", "  ", "<|endoftext|>", " \n \n", "straße ", "ΟΔΟΣ ", "Å", "ǅ", "word. "]
    texts = [x[1] or "" for x in awkward_rows()] + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    from tokenizers import Tokenizer
    tokenizer, encode = Tokenizer.from_file(Z.vocabulary(name)), kind(Z.vocabulary(name))      # untouched
    texts += ["I'm <|endoftext|> OK", "<|startoftext|>a <|endoftext|>", "x<|endoftext|", "word <|endoftext|>" * 3]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encode(text), "<u4").tolist() == want.ids, repr(text)


@pytest.mark.parametrize("kind,name", [(Z.SpaceLed, "byte_bpe_50k.json"), (Z.SpaceFree, "word_bpe_49k.json")])
def test_a_word_is_asked_for_once_whatever_marks_follow_it(kind, name, monkeypatch):
    monkeypatch.setattr(Z, "CACHE_TAILED", 1)
    encode = kind(Z.vocabulary(name))
    pieces = encode.rest if kind is Z.SpaceLed else encode.pieces
    asked, model = [], pieces.model

    class Model:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    pieces.model = Model()
    text = "a" + "".join(f" word{t}" for t in ("", ",", ".", "!?", "...", ",")) + " other."
    from tokenizers import Tokenizer
    want = Tokenizer.from_file(Z.vocabulary(name)).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text), "<u4").tolist() == want
    assert len([w for w in asked if w.endswith("word")]) == 1
    assert sum(p not in ("a", "", "word", "other") for p in pieces) == 1


def test_other_white_space_is_all_that_python_knows():
    import sys
    other = {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()} - {" ", "\n"}
    assert set(Z.SpaceLed.OTHER) == other and set(Z.SpaceLed.ASCII_OTHER) == {c for c in other if c.isascii()}


def write(tmp_path, docs, frame_ids=100):
    with open(tmp_path / "x.tok", "wb") as f:
        w = T.TokenWriter(f, frame_ids)
        for doc_id, ids in docs:
            w.add(doc_id, np.array(ids, "<u4").tobytes())
        w.close()
    return tmp_path / "x.tok"


def test_file_round_trip_and_random_access(tmp_path):
    r = np.random.default_rng(0)
    docs = [(None, [7])] + [(k // 2, r.integers(0, 50257, r.integers(0, 260)).tolist()) for k in range(60)]
    path = write(tmp_path, docs)
    with open(path, "rb") as f:
        reader = T.TokenReader(f)
        got = [(d, ids.tolist()) for d, _, ids in reader.documents()]
        assert got == docs
        assert [ids.tolist() for _, _, ids in reader.documents(reader.find(17))] == [docs[35][1], docs[36][1]]
        opened = []
        frame = reader.frame
        reader.frame = lambda k: opened.append(k) or frame(k)
        list(reader.documents(reader.find(17)))
        assert len(set(opened)) <= 2 < len(reader.table)
    # Plain zstandard decoders skip the index and the table.
    data = path.read_bytes()
    plain = b"".join(iter(lambda s=zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True): s.read(1 << 16), b""))
    assert np.frombuffer(plain, "<u4").tolist() == [x for _, ids in docs for x in ids]
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1


def test_damage_is_found(tmp_path):
    path = write(tmp_path, [(1, list(range(400)))])
    data = bytearray(path.read_bytes())
    with open(path, "rb") as f:
        size = int(T.TokenReader(f).table[0][0])
    data[size // 2] ^= 1
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(Exception):
        list(T.TokenReader(f).documents())


def test_awkward_documents(spark):
    folder = shared_path(spark, "tokens", uuid.uuid4().hex)
    manifest = T.write_tokens(awkward(spark, clash=("path", "start")), folder, BYTE, 0, frame_ids=500).cache()
    got = T.read_tokens(manifest, folder).collect()
    tokenizer = Z.load_tokenizer(BYTE)
    rows = sorted(((d is not None, d or 0, t or "") for d, t, *_ in awkward_rows()))
    start = 0
    for r, (has, d, t) in zip(sorted(got, key=lambda r: r.start), rows, strict=True):
        want = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, list(r.ids)) == (d if has else None, start, want)
        start += len(want)
    assert {(r.doc_id, r.start, r.n_tokens) for r in T.read_digests(manifest, folder).collect()} == {(r.doc_id, r.start, len(r.ids)) for r in got}


def test_empty(spark):
    folder = shared_path(spark, "tokens", uuid.uuid4().hex)
    manifest = T.write_tokens(empty(spark), folder, BYTE, 0)
    assert T.read_digests(manifest, folder).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in T.op4_token_frames(spark, SF_SMALL).collect()}
    start = 0
    for d, e in zip(docs, Z.load_tokenizer(BYTE).encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        assert tuple(got[d.doc_id]) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_rows_without_ids_spread_over_files(spark):
    docs = spark.range(0, 20_000).selectExpr("cast(null as long) doc_id", "concat('word ', id % 5000) text").union(spark.range(0, 50).selectExpr("id", "'same'"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = shared_path(spark, "tokens", uuid.uuid4().hex)
        files = T.materialize(T.write_tokens(docs, folder, BYTE, 0), "manifest")
        assert files.count() >= 6 and files.agg({"n_docs": "max"}).first()[0] < 6000
        got = T.read_digests(files, folder).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [None] * 20_000 + list(range(50))
