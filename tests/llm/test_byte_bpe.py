import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from colsense.llm import byte_bpe

RAW = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def truth():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(RAW), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(RAW, P.PATTERN)


TEXTS = ["", " ", "  \n\n a", "hello world's", "a" * 1000, "ab" * 500, "é" * 77 + "ß😀", "!!!???###" * 9, "x=1;\t\ty = 2\r\n" * 5, "aaa bbb" + " " * 4, "1234567890" * 20, "<|endoftext|>"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_library(codec, truth, text):
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == truth.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_random_pieces(codec, truth):
    rng = random.Random(5)
    alphabets = [bytes(range(256)), b"ab", b"the anion", b" \n\t", "éèßñ".encode()]
    for _ in range(3000):
        piece = bytes(rng.choices(rng.choice(alphabets), k=rng.randint(1, 40)))
        assert codec.bpe.encode_piece(piece) == truth._core_bpe.encode_single_piece(piece), piece


def test_long_piece_is_linear(codec, truth):
    piece = ("abcdefgh" * 20_000).encode()
    assert len(codec.bpe.encode_piece(piece)) < len(piece)


def test_query_over_odd_rows(spark, truth):
    rows = [(1, "hello there"), (2, None), (3, ""), (None, "hello there"), (1, "hello there"), (5, "long " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("N_TOKENS", F.lit(0))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(docs).collect()}
    want = set()
    for key, text in rows:
        ids = truth.encode_ordinary(text or "")
        want.add((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    kept = byte_bpe.encode(docs, RAW, P.PATTERN)
    assert kept.columns == ["doc_id", "text", "n_tokens", "ids"] and kept.count() == len(rows)
    assert byte_bpe.digests(docs.limit(0)).count() == 0
