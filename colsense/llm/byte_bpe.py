"""Byte-level BPE encoding and decoding with exact merges in linear time.

A text is cut by the vocabulary's pattern; each piece is encoded on its own.
For a piece, an Aho-Corasick automaton over the vocabulary (bytes as Latin-1)
gives the tokens that start at each byte.  The encoder takes the longest token
that may follow the one before it and steps back where none may.  Two tokens
may stand side by side if merging their joined bytes gives just those two; the
answer is memoised.  A prefix has one valid encoding, so a place that failed
once is never entered again, and the work is linear in the piece.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to no bytes; null ids decode as none; repeated rows are encoded alike;
columns of the input beyond the text are kept, except that ``ids``,
``n_tokens`` and ``decoded`` replace columns of the same name (any case).
"""

from __future__ import annotations

import base64
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.llm import _common

#: Bounds of the memos: pieces, adjacent pairs, and the longest piece that is kept.
PIECES, PAIRS, PIECE_CHARS = 400_000, 400_000, 48


def load_ranks(path: str) -> bytes:
    """Return the raw rank file; the vocabulary is fixed, about a megabyte."""
    return Path(path).read_bytes()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class ByteBPE:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.memo: dict[tuple[int, int], bool] = {}
        # The two tokens that merge into each token; a single byte has none.
        self.halves: dict[int, tuple[int, int] | None] = {}
        automaton = ahocorasick.Automaton()
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            if len(token) > 1:
                halves = self._split(token, rank)
                if halves is None:  # no merges lead to it: only a whole piece can be this token
                    continue
                self.halves[rank] = halves
            else:
                self.halves[rank] = None
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        self.automaton = automaton
        self.memo.clear()

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left in self.halves and right in self.halves and left != rank != right and self._stay_apart(left, right, rank):
                return left, right
        return None

    def _stay_apart(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Tell whether the merges of both tokens' bytes, up to rank ``before``, end in just these two.

        Walks back in time: undo whichever token was made last, and see at each
        moment whether a merge over the border would have come sooner.
        """
        until = before
        while True:
            over = self.ranks.get(self.tokens[left] + self.tokens[right])
            if over is not None and over < until:
                return False
            made_left, made_right = self.halves[left], self.halves[right]
            if made_left is None and made_right is None:
                return True
            if made_right is None or (made_left is not None and left > right):
                until, left = left, made_left[1]
            else:  # of two equal merges, the one over the border stands further left and wins
                until, right = right + 1, made_right[0]

    def may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= PAIRS:
                self.memo.clear()
            known = self.memo[key] = self._stay_apart(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(piece.decode("latin-1")):
            starts[end - match[1] + 1].append(match)  # shorter tokens come first
        failed = bytearray(size + 1)
        out: list[int] = []
        tried: list[int] = []
        at, choice = 0, len(starts[0]) - 1 if size else -1
        while at < size:
            here = starts[at]
            while choice >= 0:
                token, length = here[choice]
                if not failed[at + length] and (not out or self.may_follow(out[-1], token)):
                    break
                choice -= 1
            if choice >= 0:
                out.append(token)
                tried.append(choice)
                at += length
                choice = len(starts[at]) - 1 if at < size else -1
            else:
                failed[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a single byte")
                at -= len(self.tokens[out.pop()])
                choice = tried.pop() - 1
        return out


class _Pieces(dict):
    """Piece -> its ids as little-endian 32-bit integers, bounded."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = self.bpe.encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """Whole-text encoder and decoder."""

    def __init__(self, raw: bytes, pattern: str):
        import regex

        self.bpe = ByteBPE(parse_ranks(raw))
        self.find = regex.compile(pattern).findall
        self.pieces = _Pieces(self.bpe)
        self.table = [self.bpe.tokens.get(i, b"") for i in range(max(self.bpe.tokens, default=-1) + 1)]

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text))) if text else b""

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """Return the worker's codec for this vocabulary, made once per process."""
    key = (zlib.crc32(raw), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def _transform(df: DataFrame, source: str, raw: bytes, pattern: str, steps: str) -> DataFrame:
    spark = df.sparkSession
    added = {"encode": ["n_tokens", "ids"], "decode": ["decoded"], "both": ["n_tokens", "ids", "decoded"]}[steps]
    # Positions, not names: the input may hold names that clash or differ in case only.
    keep = [i for i, name in enumerate(df.columns) if name.lower() not in added]
    at = [i for i, name in enumerate(df.columns) if name == source][0]
    kept = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    kept = kept.select(F.col(f"c{at}").alias("source"), *[F.col(f"c{i}").alias(f"k{i}") for i in keep])
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    types = {"n_tokens": LongType(), "ids": BinaryType(), "decoded": BinaryType()}
    schema = StructType([f for f in kept.schema if f.name != "source"] + [StructField(n, types[n]) for n in added])
    _common.bound_batches(spark)

    def run(batches):
        made = codec(raw, pattern)
        for batch in batches:
            values = batch.column(0).to_pylist()
            ids = [made.encode(x) for x in values] if steps != "decode" else values
            arrays = list(batch.columns[1:])
            if steps != "decode":
                arrays += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if steps != "encode":
                arrays.append(pa.array([made.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[1:], *added])

    out = kept.mapInArrow(run, schema)
    return out.toDF(*[df.columns[i] for i in keep], *added)


def encode(df: DataFrame, raw: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of column ``text``."""
    return _transform(df, text, raw, pattern, "encode")


def decode(df: DataFrame, raw: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary) of column ``ids``."""
    return _transform(df, ids, raw, pattern, "decode")


def round_trip(df: DataFrame, raw: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids`` and ``decoded``, the ids decoded again in the same pass."""
    return _transform(df, text, raw, pattern, "both")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Round-trip every document and return digests of its ids and of the decoded bytes."""
    import public_tokenizers

    raw = load_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = round_trip(docs.select("doc_id", "text"), raw, public_tokenizers.PATTERN)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``: n_tokens, and SHA-256 of ids and decoded bytes."""
    return digests(_common.table(spark, sf_dir, "documents"))
