"""Token-id files compressed by a static range asymmetric numeral system (rANS).

Writing: texts are tokenised once into a written table; the ids of all
documents are counted into one frequency table, shared by all files; documents
are range-partitioned and sorted by id, and each task writes one file.

A file is a row of blocks of whole documents, about ``BLOCK_TOKENS`` ids each.
A block is coded on its own by up to ``LANES`` interleaved 64-bit states that
feed one stream of 32-bit words.  Every ``CHECK_STEPS`` steps it has a
checkpoint (states and place in the stream), so that even one block can be
decoded in parallel; checksums cover the stored bytes and the decoded ids.

Layout, little-endian.  File: ``TOK1``, scale bits (u32), CRC of the table
(u32), blocks.  Block: the fields of ``_HEAD``, document ids (i64), flags of
null ids (u8), lengths (i64), checkpoint places (u64) and states (u64), words
(u32).  ``table.npy`` has the frequencies; ``manifest`` (Parquet) names each
block's file, place and size, of attempts that succeeded only.  Files are
written through pyarrow's file systems, under names that no other attempt uses.

Defined results: a null text counts as empty; an empty text has only the end
id; null document ids come first; rows that share an id are put in the order of
their ids' hash; an empty table makes no files; further columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsense.llm import _common

SCALE_BITS, LANES, CHECK_STEPS, BLOCK_TOKENS, FILE_TOKENS = 20, 1024, 128, 1 << 18, 1 << 23
WORDS, PARTS, TOGETHER, SEPARATOR, MARKS = 300_000, 800_000, 128, "~", "#*$%&!.,;:?|<>()"
#: Letters of ASCII and Latin-1 are composed, and their lower case is what the vocabulary makes of them.
_LETTERS, _LOWER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_CUT = f"^(?P<letters>[{_LETTERS}]+)(?P<marks>[{re.escape(MARKS)}]*)$"
_LOW, _MAGIC = np.uint64(1 << 31), b"TOK1"
#: Texts on which a vocabulary shows whether it looks across white space, keeps case or treats marks otherwise.
SAMPLES = ["The Quick brown FOX,  jumps!! over 12.5 lazy dogs' tails.", "a\tb\n\nC d", " leading and trailing ", "Élan Ünder ÑANDÚ straße œuvre", "x~y ~ z", "snake_case CamelCase http://a.b/c?d=e&f", "日本語 текст 한국어 🙂 e\u0301", "word word\u00a0word\u2003word", "(a) [b] {c} <d> 'e' \"f\" #g $h %i &j *k"]
_HEAD = struct.Struct("<4sIQIIQII")  # magic, documents, ids, lanes, checkpoints, words, CRC of what follows the head, CRC of the ids as u32


# Tokenising


class Tokens:
    """The library's ids of whole texts, with bounded memos of the ids of words.

    A vocabulary may drop white space and never look across it, so that a text's
    ids are those of its words; whether it does is tried on ``SAMPLES``, and if
    not, texts are encoded whole.  A word of letters and then marks gives the ids of
    its letters, in lower case, and those of the marks.  Each different word of a
    batch is cut and looked up once.  What the memos lack
    is encoded together, with a word between that has one id which nothing else
    can give; words with that character go alone.  Letters in lower case are
    encoded without the normaliser where it leaves them as they are.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.library = self.plain = Tokenizer.from_str(raw.decode())
        if self.library.normalizer is not None and self.library.normalizer.normalize_str(_LOWER) == _LOWER:
            self.plain = Tokenizer.from_str(raw.decode())
            self.plain.normalizer = None
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        mark = self._ids(self.library, [SEPARATOR])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.words: dict[str, bytes] = {}  # marks, and words that aren't letters and then marks
        self.parts: dict[str, bytes] = {}  # letters in lower case
        self.by_words = True
        try:
            self.by_words = self.encode(SAMPLES) == self._whole(SAMPLES)
        except ValueError:
            self.by_words = False
        self.words, self.parts = {}, {}

    def _whole(self, texts: Iterable[str | None]) -> list[bytes]:
        return [np.array(ids, self.kind).tobytes() for ids in self._ids(self.library, [x or "" for x in texts])]

    def _ids(self, library, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, library, words: list[str]) -> dict[str, bytes]:
        """Return the library's ids of ``words``."""
        out = {}
        joined = [w for w in words if SEPARATOR not in w] if self.mark is not None else []
        for at in range(0, len(joined), TOGETHER):
            part = joined[at : at + TOGETHER]
            ids = np.array(self._ids(library, [f" {SEPARATOR} ".join(part)])[0], self.kind)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part) - 1:
                raise ValueError("the separator isn't a token of its own")
            size, data = self.kind.itemsize, ids.tobytes()
            starts, ends = [0, *((ends + 1) * size).tolist()], [*(ends * size).tolist(), len(data)]
            out.update(zip(part, [data[a:b] for a, b in zip(starts, ends)]))
        for word in words:
            if word not in out:
                out[word] = np.array(self._ids(library, [word])[0], self.kind).tobytes()
        return out

    def _known(self, memo: dict[str, bytes], most: int, library, words: pa.Array) -> tuple[dict[str, bytes], pa.Array]:
        """Return the memo, of at most ``most`` words, and the ids of ``words`` (null: null)."""
        coded = words.dictionary_encode()
        texts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        found = list(map(memo.get, texts))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            got = self._ask(library, [texts[i] for i in missing])
            for i in missing:
                found[i] = got[texts[i]]
            memo.update(got)
            if len(memo) > most:  # the later half stays
                memo = dict(islice(memo.items(), len(memo) - most // 2, None))
        return memo, pa.array(found, pa.large_binary()).take(coded.indices)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Return the ids of all texts in a row, and the place where each text's end."""
        if not self.by_words or not len(texts):
            whole = self._whole(texts.to_pylist())
            return np.frombuffer(b"".join(whole), self.kind), np.cumsum([len(x) // self.kind.itemsize for x in whole], dtype=np.int64)
        # Only spaces that the vocabulary surely drops are cut at; others stay inside a "word".
        spaced = pc.replace_substring(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), "\t", " ")
        split = pc.split_pattern(spaced, " ")
        coded = split.values.dictionary_encode()
        words = coded.dictionary
        letters, marks = pc.extract_regex(words, _CUT).flatten()
        self.parts, first = self._known(self.parts, PARTS, self.plain, pc.utf8_lower(letters))
        self.words, second = self._known(self.words, WORDS, self.library, pc.coalesce(marks, words))
        ids = pc.binary_join_element_wise(first, second, pa.scalar(b"", pa.large_binary()), null_handling="skip").take(coded.indices)
        _, places, data = ids.buffers()
        places = np.frombuffer(places, np.int64, len(ids) + 1) // self.kind.itemsize
        return np.frombuffer(data or b"", self.kind, places[-1]), places[split.offsets.to_numpy()[1:]]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]


_TOKENS: dict[int, Tokens] = {}


def tokens(raw: bytes) -> Tokens:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = zlib.crc32(raw)
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(raw)
    return _TOKENS[key]


# The coder


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Scale counts to frequencies that sum to 2**bits, at least 1 where a count is."""
    counts = np.asarray(counts, np.float64)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return np.zeros(len(counts), np.uint32)
    if len(seen) > 1 << (bits - 1):
        raise ValueError("too many symbols for the scale")
    out = np.zeros(len(counts), np.int64)
    out[seen] = np.maximum(1, np.floor(counts[seen] * ((1 << bits) / counts.sum())))
    short = (1 << bits) - int(out.sum())
    order = seen[np.argsort(-out[seen], kind="stable")]
    if short > 0:
        out[order[0]] += short
    for s in order:  # what the least frequent took is given back by the most frequent
        if short >= 0:
            break
        take = min(-short, int(out[s]) // 2)
        out[s] -= take
        short += take
    return out.astype(np.uint32)


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.start = np.cumsum(self.freq) - self.freq
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int, check_steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Return (checkpoint places, checkpoint states, words); the first checkpoint is the start."""
        n, bits = len(ids), np.uint64(self.bits)
        steps = -(-n // lanes)
        freq, start = self.freq[ids], self.start[ids]
        if n and not freq.all():
            raise ValueError("an id that the table lacks")
        top = freq << np.uint64(63 - self.bits)
        state = np.full(lanes, _LOW, np.uint64)
        chunks: list[np.ndarray] = []
        places, states, written = [], [], 0
        for step in range(steps - 1, -1, -1):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            x = state[: b - a]
            full = x >= top[a:b]
            if full.any():
                chunks.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                written += len(chunks[-1])
                x = np.where(full, x >> np.uint64(32), x)
            q, r = np.divmod(x, freq[a:b])
            state[: b - a] = (q << bits) + r + start[a:b]
            if step % check_steps == 0:
                places.append(written)
                states.append(state.copy())
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
        return written - np.array(places[::-1], np.uint64), np.array(states[::-1], np.uint64).reshape(len(states), lanes), words

    def decode(self, n: int, lanes: int, check_steps: int, places: np.ndarray, states: np.ndarray, words: np.ndarray, part: int | None = None) -> np.ndarray:
        """Return all ids, or those from checkpoint ``part`` to the next."""
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        first, last = (0, -(-n // lanes)) if part is None else (part * check_steps, min(-(-n // lanes), (part + 1) * check_steps))
        out = np.empty(min(n, last * lanes) - first * lanes if last > first else 0, np.uint32)
        if not len(out):
            return out
        state, at = states[part or 0].copy(), int(places[part or 0])
        for step in range(first, last):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            x = state[: b - a]
            slot = x & mask
            symbol = self.slots[slot]
            out[a - first * lanes : b - first * lanes] = symbol
            x = self.freq[symbol] * (x >> bits) + slot - self.start[symbol]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
                at += len(low)
            state[: b - a] = x
        return out


_CODERS: dict[int, Coder] = {}


def coder_of(freq: np.ndarray) -> Coder:
    """Return the worker's coder for this table."""
    key = zlib.crc32(freq.astype("<u4").tobytes())
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(freq)
    return _CODERS[key]


# Blocks and files


def pack(coder: Coder, keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Return one block's bytes."""
    lanes = max(1, min(LANES, len(ids)))
    places, states, words = coder.encode(ids, lanes, CHECK_STEPS)
    body = b"".join(
        (
            np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is None for k in keys], "u1").tobytes(), np.array(lengths, "<i8").tobytes(),
            places.astype("<u8").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
        )
    )
    return _HEAD.pack(b"BLK1", len(keys), len(ids), lanes, len(places), len(words), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def unpack(coder: Coder, data: bytes, part: int | None = None) -> tuple[list[int | None], list[int], np.ndarray]:
    """Check and decode one block: document ids, lengths, and ids (or those from checkpoint ``part`` to the next)."""
    magic, docs, n, lanes, checks, n_words, crc, ids_crc = _HEAD.unpack_from(data)
    body = memoryview(data)[_HEAD.size :]
    if magic != b"BLK1" or zlib.crc32(body) != crc:
        raise ValueError("a block's bytes are damaged")
    at = 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(body, kind, count, at)
        at += got.nbytes
        return got

    keys, nulls, lengths = take("<i8", docs), take("u1", docs), take("<i8", docs)
    places, states = take("<u8", checks), take("<u8", checks * lanes).reshape(checks, lanes)
    ids = coder.decode(n, lanes, CHECK_STEPS, places, states, take("<u4", n_words), part)
    if part is None and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block's ids are damaged")
    return [None if z else int(k) for k, z in zip(keys, nulls)], lengths.tolist(), ids


def _open(folder: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    return files, path.rstrip("/")


def _blocks(rows: Iterable[tuple[int | None, bytes]], kind: np.dtype) -> Iterator[tuple[list, list[int], np.ndarray]]:
    keys, parts, size = [], [], 0
    for key, data in rows:
        keys.append(key)
        parts.append(data)
        size += len(data) // kind.itemsize
        if size >= BLOCK_TOKENS:
            yield keys, [len(p) // kind.itemsize for p in parts], np.frombuffer(b"".join(parts), kind)
            keys, parts, size = [], [], 0
    if keys:
        yield keys, [len(p) // kind.itemsize for p in parts], np.frombuffer(b"".join(parts), kind)


_STAGED = "doc_id bigint, n bigint, ids binary, counts binary"


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> None:
    """Tokenise ``docs`` (doc_id long, text) by the library's file ``vocabulary`` and write files to ``folder``."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        raw = f.read()  # fixed: a vocabulary of one or two megabytes
    kind = tokens(raw).kind
    size = tokens(raw).library.get_vocab_size()
    shared = spark.sparkContext.broadcast(raw)

    def encode(batch: pa.RecordBatch) -> dict:
        found, ends = tokens(shared.value).encode_column(batch.column(1))
        found, ends = np.insert(found, ends, end_id), ends + np.arange(1, len(ends) + 1)
        total = np.bincount(found, minlength=size)
        seen = np.flatnonzero(total)  # the batch's counts go with its first row, so that no other pass need count ids
        counts = np.stack([seen, total[seen]]).astype("<u4").tobytes()
        places = np.concatenate([[0], ends])
        ids = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(places * kind.itemsize), pa.py_buffer(found)]).cast(pa.binary())
        return {"doc_id": batch.column(0), "n": pa.array(np.diff(places)), "ids": ids, "counts": [counts] + [None] * (len(ends) - 1)}

    staged = f"{folder}/staged"
    _common.map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), encode, _STAGED).write.option("compression", "zstd").parquet(staged)
    made = spark.read.schema(_STAGED).parquet(staged)

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                ids, counted = np.frombuffer(x, "<u4").reshape(2, -1)
                total[ids] += counted
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for i, n in made.select("counts").filter("counts IS NOT NULL").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary
        counts[i] = n
    freq = scaled(counts)
    files, path = _open(folder)
    files.create_dir(path, recursive=True)
    held = io.BytesIO()
    np.save(held, freq)
    with files.open_output_stream(f"{path}/table.npy") as out:
        out.write(held.getvalue())

    def save(batches):
        from pyspark import TaskContext

        coder, (store, top) = coder_of(freq), _open(folder)
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}.tok"
        rows = ((k, x) for batch in batches for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        listed, out = [], None
        for i, (keys, lengths, ids) in enumerate(_blocks(rows, kind)):
            if out is None:
                out = store.open_output_stream(f"{top}/{name}")
                out.write(_MAGIC + struct.pack("<II", coder.bits, coder.crc))
                at = len(_MAGIC) + 8
            data = pack(coder, keys, lengths, ids)
            out.write(data)
            listed.append((number, name, i, at, len(data), len(keys), len(ids)))
            at += len(data)
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array(c) for c in zip(*listed)], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("block", pa.int32()), *[(n, pa.int64()) for n in ("at", "size", "docs", "ids")]]))

    parts = max(1, -(-int(counts.sum()) // FILE_TOKENS))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("row").asc()]
    keyed = made.select("doc_id", "ids", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    dealt.mapInArrow(save, "part int, file string, block int, at bigint, size bigint, docs bigint, ids bigint").write.parquet(f"{folder}/manifest")
    _common.delete(spark, staged)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Return doc_id, start (ids of all documents before), n_tokens and ids (binary, little-endian u32) of a folder's files."""
    manifest = spark.read.schema("part int, file string, block int, at bigint, size bigint, docs bigint, ids bigint").parquet(f"{folder}/manifest")
    files, path = _open(folder)
    with files.open_input_file(f"{path}/table.npy") as f:
        freq = np.load(io.BytesIO(f.read()))
    # One row for each file goes to one task; blocks are summed inside their file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = manifest.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("inside", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(firsts, "part")
    placed = placed.select("file", "at", "size", (F.col("first") + F.col("inside")).alias("start"))
    _common.bound_batches(spark)

    def load(batches):
        coder, (store, top) = coder_of(freq), _open(folder)
        for batch in batches:
            for name, at, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_file(f"{top}/{name}") as f:
                    magic, (bits, crc) = f.read(4), struct.unpack("<II", f.read(8))
                    if magic != _MAGIC or (bits, crc) != (coder.bits, coder.crc):
                        raise ValueError(f"{name} was written with another table")
                    f.seek(at)
                    keys, lengths, ids = unpack(coder, f.read(size))
                data = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                cut = [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(cut, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    spread = placed.repartition(min(max(1, manifest.count()), int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "at")
    return spread.mapInArrow(load, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to files in the shared folder and return what ``read`` gives."""
    import public_tokenizers

    folder = _common.new_folder(docs.sparkSession, "tokens")
    write(docs, folder, vocabulary or public_tokenizers.path("word_bpe_49k.json"), end_id)
    return read(docs.sparkSession, folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` as read back from its token files."""
    back = round_trip(_common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
