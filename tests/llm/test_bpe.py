import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from wayfloor.llm.bpe import decode, encode, encoder, token_digest, tokenizer_path


def expected(text):
    enc = encoder(tokenizer_path(), public_tokenizers.PATTERN)
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def texts(seed):
    rng = random.Random(seed)
    bits = ["the", " cat", "  ", "\n", "\n\n", " 's", "'ve", "12", "é", "日本", "\U0001f600", "!!", "\t", " ", " x", "a" * 40]
    return [None, "", " ", "<|endoftext|>"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 400))) for _ in range(40)] + ["a" * 900, " " * 700, "b " * 500]


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 512), (64, 16), (100, 90), (7, 3)])
def test_ids_are_those_of_the_library(spark, chunk, overlap):
    rows = list(enumerate(texts(chunk)))
    rows.append(rows[10])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in token_digest(docs, chunk_chars=chunk, overlap_chars=overlap).collect())
    assert got == sorted((i, *expected(t)) for i, t in rows)


@pytest.mark.parametrize("seed", range(2))
def test_chunks_out_of_step_are_repaired(spark, seed):
    """Pre-tokens longer than the overlap, and than several chunks, at any place; repeated rows."""
    rng = random.Random(seed)
    words = ["a" * 30, "b" * 300, "é" * 90, "!" * 70, " " * 50 + "x", "the ", "cat's ", "\n\n", "12345 ", "日" * 45, "z" * 1000]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randint(20, 60)))) for i in range(12)]
    rows += [(90, "a" * 3000), (91, " " * 3000), (92, "c" * 700 + " dog" * 200)] + rows[:2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in token_digest(docs, chunk_chars=64, overlap_chars=16).collect())
    assert got == sorted((i, *expected(t)) for i, t in rows)


def test_a_long_match_leaves_the_other_pieces_whole(spark):
    text = " word" * 1600
    at = 1000 - 30
    docs = spark.createDataFrame([(1, text), (2, text[:at] + "q" * 140 + text[at:])], "doc_id long, text string")
    sizes = {}
    for r in encode(docs, chunk_chars=1000, overlap_chars=50).collect():
        sizes.setdefault(r.doc_id, []).append(len(r.ids))
    assert len(sizes[2]) >= len(sizes[1]) and max(sizes[2]) < 2 * max(sizes[1])


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(5)) if t], "doc_id long, text string")
    got = decode(encode(docs, chunk_chars=50, overlap_chars=20)).collect()
    back = {}
    for r in sorted(got, key=lambda r: r.piece):
        back[r.doc_id] = back.get(r.doc_id, b"") + bytes(r.data)
    assert back == {r.doc_id: r.text.encode() for r in docs.collect()}


def test_edges(edge_docs, empty_docs):
    got = token_digest(edge_docs)
    assert got.count() == edge_docs.count()
    assert token_digest(empty_docs).count() == 0
