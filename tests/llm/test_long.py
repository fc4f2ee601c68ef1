"""Texts of several million characters, one of them a single word, through every operator on documents."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.llm import chat, media, minhash, mixing, packing, quality, scoring, substring

WORDS = [f"word{i % 9973}" for i in range(400_000)]
TEXTS = [" ".join(WORDS), "x" * 2_000_000, " ".join(WORDS[:399_990]), "short one", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")


def test_media(docs):
    got = {r.doc_id: r for r in media.media_digests(docs).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (got[i].n_bytes, got[i].payload_sha256) == (len(raw), hashlib.sha256(payload).hexdigest())


def test_quality_and_mixing(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).where("score between 0 and 1").count() == len(TEXTS)
    assert {r.doc_id: r.size for r in mixing.mix_sources(docs).collect()} == {0: 400_000, 1: 1, 2: 399_990, 3: 2, 4: 0}


def test_packing(docs):
    rows = packing.pack(docs.where("doc_id <> 1")).collect()
    ids = packing.word_ids(packing.default_tokenizer()).tok.encode(TEXTS[0], add_special_tokens=False).ids + [1]
    mine = sorted((r.piece, r.length, r.ids_crc32) for r in rows if r.doc_id == 0)
    assert mine == [(k // 4096, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]


def test_near_and_repeats(docs):
    assert {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup_digests(docs).collect()}
    assert got == {0: (400_000, 400_000), 1: (1, 0), 2: (399_990, 399_990), 3: (2, 0), 4: (0, 0)}


def test_scores(docs):
    got = {r.doc_id: r for r in scoring.score_documents(docs).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {0: 400_001, 1: 2, 2: 399_991, 3: 3, 4: 1}
    assert all(np.isfinite(r.score) and r.score < 0 for r in got.values())


def test_chats(spark):
    turns = spark.createDataFrame([(1, 0, "user", TEXTS[0]), (1, 1, "assistant", TEXTS[1]), (1, 2, "user", "end")], "conv_id long, turn long, role string, text string")
    r = chat.chat_digests(turns).first()
    assert (r.n_turns, r.loss_chars) == (3, 2_000_000) and r.loss_sha256 == hashlib.sha256(TEXTS[1].encode()).hexdigest()
    assert chat.format_chats(turns).agg(F.sum("n_new")).first()[0] == 3
