import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colsense.llm import token_files as R

VOCABULARY = P.path("word_bpe_49k.json")
ODD = [None, "", " ", "Hello, World's end", "a~b ~ ~~", "<|endoftext|> x<|startoftext|>y", "é é ́a b c\x1cd", "ΑΣ ΣΑΣ", "日本語 テスト 😀", "don't 1234 ||| --~--", "x" * 5000, "tab\tnew\nline\r\n end"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_tokens_match_library(library, monkeypatch):
    raw = open(VOCABULARY, "rb").read()
    for words in (400_000, 6):
        monkeypatch.setattr(R, "WORDS", words)
        monkeypatch.setattr(R, "PARTS", words)
        made = R.Tokens(raw)
        for _ in range(2):
            got = [np.frombuffer(x, made.kind).tolist() for x in made.encode(ODD)]
            assert got == [library.encode(x or "", add_special_tokens=False).ids for x in ODD]


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 300_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, 49_407).astype(np.uint32)
    coder = R.Coder(R.scaled(np.bincount(ids, minlength=49_408)))
    data = R.pack(coder, [None, 3], [n, 0], ids)
    keys, lengths, back = R.unpack(coder, data)
    assert keys == [None, 3] and lengths == [n, 0] and (back == ids).all()
    parts = [R.unpack(coder, data, k)[2] for k in range(-(-n // (R.CHECK_STEPS * max(1, min(R.LANES, n)))))]
    assert n == 0 or (np.concatenate(parts) == ids).all()
    if n == 300_000:
        counts = np.bincount(ids)
        p = counts[counts > 0] / n
        assert len(data) * 8 < 1.06 * n * -(p * np.log2(p)).sum() + 64 * R.LANES * 4
        with pytest.raises(ValueError):
            R.unpack(coder, data[:-1] + bytes([data[-1] ^ 1]))


def test_scaled():
    for counts in ([5], [1, 0, 10**12], [1] * 1000 + [10**9], [0, 0]):
        f = R.scaled(np.array(counts))
        assert f.sum() in (0, 1 << R.SCALE_BITS) and ((f > 0) == (np.array(counts) > 0)).all()


def test_files(spark, library, monkeypatch):
    monkeypatch.setattr(R, "FILE_TOKENS", 500)
    rows = [(i * 7 % 40, t) for i, t in enumerate(ODD * 3)] + [(None, "null id"), (None, None), (-5, "first"), (3, "same"), (3, "same"), (1000, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(4)
    got = sorted((r.start, r.n_tokens, r.doc_id, r.ids_crc32) for r in R.round_trip(docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")).collect())
    want = [(key, library.encode(t or "", add_special_tokens=False).ids + [2]) for key, t in rows]
    assert sorted((r[2] is None, r[2] or 0, r[1], r[3]) for r in got) == sorted((k is None, k or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in want)
    assert [r[0] for r in got] == np.cumsum([0] + [r[1] for r in got])[:-1].tolist()
    keys = [r[2] for r in got]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
    assert R.round_trip(docs.limit(0)).count() == 0


def test_vocabulary_that_looks_across_white_space():
    """Another vocabulary, of bytes with their spaces and cases, isn't cut at words: its ids are the library's."""
    import json

    from tokenizers import Tokenizer

    letters = [chr(c) for c in range(33, 127)] + ["\u0120"]
    vocab = {c: i for i, c in enumerate(letters)} | {"\u0120a": 200, "\u0120b": 201}
    raw = json.dumps({"version": "1.0", "model": {"type": "BPE", "vocab": vocab, "merges": ["\u0120 a", "\u0120 b"]}, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}})
    own, library = R.Tokens(raw.encode()), Tokenizer.from_str(raw)
    assert not own.by_words
    for text in ("A b a", "b a~B", " a  b"):
        assert np.frombuffer(own.encode([text])[0], own.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_batch_looks_up_each_different_word_once(library):
    """Lookups, and words that the library is asked for, go by different words, not by all words; the memos stay bounded."""

    class Counted(dict):
        lookups = 0

        def get(self, *args):
            Counted.lookups += 1
            return super().get(*args)

    made = R.Tokens(open(VOCABULARY, "rb").read())
    made.words, made.parts = Counted(), Counted()
    texts = ["The cat, the dog and 7 \u00e9l\u00e8ves. " * 500, None, "", "a~b the"] * 3
    got = [np.frombuffer(x, made.kind).tolist() for x in made.encode(texts)]
    assert got == [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert Counted.lookups <= 24


def test_memos_are_bounded_within_a_batch(library, monkeypatch):
    monkeypatch.setattr(R, "WORDS", 10)
    monkeypatch.setattr(R, "PARTS", 10)
    made = R.Tokens(open(VOCABULARY, "rb").read())
    texts = [" ".join(f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}! {i}x" for i in range(100))]
    for _ in range(2):
        assert np.frombuffer(made.encode(texts)[0], made.kind).tolist() == library.encode(texts[0], add_special_tokens=False).ids
        assert len(made.words) <= 10 and len(made.parts) <= 10


@pytest.mark.parametrize("kind", ["string", "large_string"])
def test_column_of_texts(library, kind):
    """Ids lie in a row and each text's end is given, for any slice of a column, an empty one and one of nulls only."""
    import pyarrow as pa

    made = R.Tokens(open(VOCABULARY, "rb").read())
    column = pa.array(ODD, kind)
    for texts in (column, column.slice(3, 5), column.slice(2, 0), pa.array([None, None], kind), pa.array([""], kind)):
        want = [library.encode(x or "", add_special_tokens=False).ids for x in texts.to_pylist()]
        ids, ends = made.encode_column(texts)
        assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(x) for x in want], dtype=int).tolist()


def test_normaliser_that_changes_letters():
    """A vocabulary that drops accents keeps its normaliser for letters too."""
    import json

    raw = json.loads(open(VOCABULARY).read())
    raw["normalizer"]["normalizers"] = [{"type": "NFD"}, {"type": "StripAccents"}, {"type": "Lowercase"}]
    raw = json.dumps(raw)
    own, library = R.Tokens(raw.encode()), Tokenizer.from_str(raw)
    for text in ("\u00c9lan \u00c9lan! na\u00efve \u00dcber", "plain words, 12 of them"):
        assert np.frombuffer(own.encode([text])[0], own.kind).tolist() == library.encode(text, add_special_tokens=False).ids
