"""Encoding and decoding against tiktoken, with chunks small enough to be stitched."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from relscope.llm import bpe, vocab

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, key string"


def texts():
    rng = random.Random(1)
    yield from [None, "", "a", "<|endoftext|> 's  \n\n x", " " * 500, "\n" * 300 + "x", "x" * 700, "don't " * 90]
    for _ in range(40):
        yield "".join(rng.choices("ab's re \n\t1é漢.", k=rng.randint(1, 400)))
    yield "!!\U00011de0!! x\U00011de0's \u0558a\u0558 \U00012550 9\U00016ff4 \u0cdc"
    yield "word " * 60 + "y" * 150 + " word" * 60


@pytest.mark.parametrize("chunk,overlap", [(40, 20), (64, 9), (10**6, 100)])
def test_segments_join_to_the_whole_texts_ids(spark, chunk, overlap):
    encoding = vocab.rank_encoding(PATH)
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts())]
    rows += [(None, "word " * 50, "x", "x"), (7, rows[7][1], "x", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in bpe.decode(bpe.encode(docs, PATH, chunk, overlap)).collect():
        got.setdefault((r.key or (r.doc_id, bytes(r.ids))), []).append((r.segment, r.doc_id, r.copies, bytes(r.ids), bytes(r.bytes)))
    found = []
    for own in got.values():
        own.sort()
        whole = (own[0][1], b"".join(x[3] for x in own), b"".join(x[4] for x in own))
        found += [whole] * (own[0][2] if own[0][2] > 1 else sum(x[0] == 0 for x in own) or 1)
    if chunk < 100:
        assert max(map(len, got.values())) > 1
    want = [(r[0], np.array(encoding.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows]
    if chunk > 10**5:
        found = [(r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in bpe.decode(bpe.encode(docs, PATH, chunk, overlap)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    rows = [(i, t, "x", "x") for i, t in enumerate(texts())] + [(7, "don't " * 90, "x", "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in bpe.op2_byte_bpe(spark, str(tmp_path)).collect()]
    want = []
    for i, t, *_ in rows:
        ids = vocab.rank_encoding(PATH).encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got) == sorted(want)


def test_nothing(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA))).collect() == []


def pieces(spark, text, chunk, overlap):
    got = bpe.decode(bpe.encode(spark.createDataFrame([(1, text, "", "")], SCHEMA), PATH, chunk, overlap)).collect()
    own = sorted((r.segment, bytes(r.ids), bytes(r.bytes)) for r in got)
    assert b"".join(i for _, i, _ in own) == np.array(vocab.rank_encoding(PATH).encode_ordinary(text), "<u4").tobytes()
    return [len(b) for *_, b in own]


@pytest.mark.parametrize("run", ["y" * 150, "-" * 150, "\n" * 150, " " * 150, "y" * 70 + "\n" * 70])
def test_cutting_resumes_after_a_long_run(spark, run):
    text = "word " * 60 + run + " word" * 60 + run + " word" * 60
    assert max(pieces(spark, text, 40, 20)) <= 300


def test_rest_in_one_piece_without_rounds(spark, monkeypatch):
    monkeypatch.setattr(bpe, "ROUNDS", 0)
    assert max(pieces(spark, "word " * 60 + "y" * 150 + " word" * 60, 40, 20)) > 400
