"""Byte-level BPE against the reference encoder of the same ranks, and round trips."""

import hashlib
import random

import public_tokenizers as tokenizers
import pytest
import tiktoken

from skein.llm import bpe

PATH = tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, tokens string, decoded string"


@pytest.fixture(scope="module")
def own():
    return bpe.Coder(bpe.read_ranks(PATH), tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoder(own):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in rows], DOCS)


def test_words_of_every_length_match(own, encoder):
    rng = random.Random(1)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab", "x", "etaoin", "éèàü", "日本語的是", "thequickand", "AB cd,1\n"]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 700))) for _ in range(60)]
    texts += [None, "", " ", " " * 999, "=" * 777, "-=" * 400, "\n" * 500, " \n" * 300, "0" * 3000, "\x00a\x00", "<|endoftext|>", "\x1c x\x85y", "x" * 200_000]
    got = list(bpe.encoded(own, texts))
    assert [g.tolist() for g in got] == [encoder.encode_ordinary(t or "") for t in texts]
    assert [d.decode() for d in own.decode(got)] == [t or "" for t in texts]


def test_texts_are_encoded_in_parts_and_words_forgotten(own, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdeé", k=5)) for _ in range(n)) for n in (0, 1, 49, 50, 51, 200, 3, 120)]
    assert [g.tolist() for g in bpe.encoded(own, texts)] == [encoder.encode_ordinary(t) for t in texts]


def test_documents_keep_rows_and_decode_to_their_texts(spark, encoder):
    rows = [(1, None), (2, ""), (3, "word"), (None, "null id"), (4, "twice é"), (4, "twice é"), (5, "long " * 5000)]
    out = bpe.round_trip(docs(spark, rows), PATH, tokenizers.PATTERN).collect()
    want = []
    for i, t in rows:
        ids, digest = encoder.encode_ordinary(t or ""), lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert bpe.round_trip(docs(spark, []), PATH, tokenizers.PATTERN).count() == 0
    tokens = bpe.encode_documents(docs(spark, rows), PATH, tokenizers.PATTERN)
    decoded = bpe.decode_documents(tokens, PATH, tokenizers.PATTERN).collect()
    assert sorted((bytes(r.decoded).decode() for r in decoded)) == sorted(t or "" for _, t in rows)


def test_unknown_ids_raise(own):
    with pytest.raises(ValueError, match="vocabulary"):
        own.decode([bpe.np.array([50_300], bpe.np.int32)])
