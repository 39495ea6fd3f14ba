"""SimHash near-duplicates: fingerprints, bit-sliced comparison in blocks, and components of the links.

1. Each text gets a 64-bit fingerprint: bit b is set if more than half of its
   shingles' XXH64 values have it.  Equal fingerprints become one node.
2. Blocks: cut 64 bits into ``radius + agree`` pieces.  Two fingerprints within
   the radius agree on at least ``agree`` of them, so each is filed under every
   choice of ``agree`` pieces and no link is missed.  ``agree`` follows from
   the number of fingerprints, so that a block stays near ``BLOCK`` of them.
3. A block larger than ``BLOCK`` (a large group of near copies) is dealt into
   chunks by hash, and each pair of chunks is compared by a task of its own.
4. Comparison: the block is stored as 64 vertical bit planes.  For a query, the
   XOR of each plane with its bit feeds a carry-save counter that starts so that
   passing the radius carries out; rows whose every lane has passed it are
   abandoned after each few planes.
5. A block reports the links as a forest (a pair of chunks only what joins
   their trees), and large-star/small-star steps find the components.

Defined results: a text without words (null too) has fingerprint 0, linked like
any other; fewer words than a shingle give one shingle of all; component_id is
the smallest id that can be reached, ids that are null never are; repeated rows
each get a row; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.llm import _common, _components

SEED, SHINGLE, RADIUS, BLOCK, TILE, LANES = 42, 4, 4, 1024, 256, 8
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Return the fingerprint of ``text``, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change and only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(itertools.accumulate(map(len, words), lambda at, n: at + n + 1, initial=-1))[1:]
        starts = [0, *[e + 1 for e in ends[: len(words) - shingle]]]
        hashes = list(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends[shingle - 1 :])), itertools.repeat(SEED)))
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Return the bits that more than half of ``hashes`` (uint64) have."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Return doc_id, digest (XXH64 of the text) and fp (bigint with the fingerprint's bits) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        made = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "digest": batch.column(2), "fp": made.view(np.int64)}

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return _common.map_batches(rows, make, f"doc_id {kind}, digest bigint, fp bigint")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Return 64 rows of 64-lane words: bit i of row b is bit b of value i."""
    lanes = -(-len(values) // 64)
    bits = np.zeros((lanes * 64, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def links(values: np.ndarray, radius: int = RADIUS, queries: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Return (i, j), i < j, of all pairs of ``values`` (uint64) that differ in at most ``radius`` bits; ``queries`` bounds i."""
    n = len(values)
    most = n if queries is None else queries
    planes = planes_of(values)
    masks = np.where(np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(bool), _FULL, np.uint64(0))
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius  # one more than the radius carries out
    found_i, found_j = [], []
    for lane in range(0, planes.shape[1], LANES):
        part = planes[:, lane : lane + LANES]
        first = lane * 64
        rows = np.arange(min(most, first + part.shape[1] * 64))  # a query has partners only above itself
        index = first + np.arange(part.shape[1] * 64)
        over = np.packbits((index[None, :] <= rows[:, None]) | (index[None, :] >= n), axis=1, bitorder="little").view(np.uint64)
        counters = [np.full(over.shape, _FULL if start >> b & 1 else 0, np.uint64) for b in range(width)]
        for plane in range(0, 64, 2):
            x = part[plane][None, :] ^ masks[plane][rows][:, None]
            y = part[plane + 1][None, :] ^ masks[plane + 1][rows][:, None]
            half = counters[0] ^ x
            carry = (counters[0] & x) | (half & y)  # carry-save: two planes enter the lowest counter at once
            counters[0] = half ^ y
            for b in range(1, width):
                more = counters[b] & carry
                counters[b] ^= carry
                carry = more
            over |= carry
            if plane % 8 == 6:
                live = (over != _FULL).any(axis=1)
                if not live.all():
                    rows, over = rows[live], over[live]
                    counters = [c[live] for c in counters]
                if not len(rows):
                    break
        if len(rows):
            at, lane_at = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
            found_i.append(rows[at])
            found_j.append(first + lane_at)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Return the smallest index of each index's component under links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (i, j, root[i], root[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(values: np.ndarray, sides: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Return edges (values) that join what ``links`` joins; with two sides, only what joins trees of different sides."""
    i, j = links(values, radius)
    if not len(i):
        return values[i], values[j]
    if sides is None:
        root = roots(len(values), i, j)
        child = np.flatnonzero(root != np.arange(len(values)))
        return values[child], values[root[child]]
    own = sides[i] == sides[j]
    tree = roots(len(values), i[own], j[own])
    i, j = tree[i[~own]], tree[j[~own]]
    root = roots(len(values), i, j)
    child = np.flatnonzero(root != np.arange(len(values)))
    return values[child], values[root[child]]


def agreeing(n: int, radius: int = RADIUS) -> int:
    """Return on how many pieces fingerprints in one block must agree, for blocks of some ``4 * BLOCK`` at most."""
    for agree in range(1, 9):
        if n / 2 ** (64 * agree / (radius + agree)) <= 4 * BLOCK:
            return agree
    return 8


def _keys(radius: int, agree: int) -> list:
    """Return a bigint column for each choice of pieces: the number of the choice and the pieces' bits, hashed if they don't fit."""
    pieces = radius + agree
    cuts = [round(64 * p / pieces) for p in range(pieces + 1)]
    out = []
    for t, chosen in enumerate(itertools.combinations(range(pieces), agree)):
        mask = sum(((1 << (cuts[p + 1] - cuts[p])) - 1) << cuts[p] for p in chosen)
        mask -= (mask >> 63) << 64
        # A collision of hashes only puts fingerprints into one block that need not be compared.
        out.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask).cast("bigint"))))
    return out


def _forests(rows: DataFrame, radius: int) -> DataFrame:
    """Compare blocks: ``rows`` (key, a, b, side, fp) come sorted by (key, a, b) and whole in a partition."""

    def tiles(batches):
        """Yield runs of whole blocks: small ones together, a pair of chunks alone."""
        held = None
        for batch in batches:
            part = [np.asarray(c) for c in batch.columns]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            if len(held[0]) < 4 * TILE:
                continue
            held = yield from cut(held, False)
        if held is not None and len(held[0]):
            yield from cut(held, True)

    def cut(held, last):
        new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])) + 1
        edges = [0, *new.tolist(), *([len(held[0])] if last else [])]
        start = 0
        for at, to in zip(edges, edges[1:]):
            pair = held[1][at] != held[2][at]
            if pair:
                if at > start:
                    yield [c[start:at] for c in held]
                yield [c[at:to] for c in held]
                start = to
            elif to - start >= TILE:
                yield [c[start:to] for c in held]
                start = to
        if last and start < len(held[0]):
            yield [c[start:] for c in held]
            start = len(held[0])
        return [c[start:] for c in held]

    def run(batches):
        for _, a, b, side, fp in tiles(batches):
            if len(fp) > 1:
                values = fp.view(np.uint64)
                if a[0] != b[0]:
                    u, v = forest(values, side, radius)
                else:
                    values = np.unique(values)
                    u, v = forest(values, None, radius)
                if len(u):
                    yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return rows.mapInArrow(run, "u bigint, v bigint")


def near_links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Return edges (u, v) of distinct fingerprints ``fp`` that have the components of all links within ``radius``."""
    spark = values.sparkSession
    _common.bound_batches(spark)
    values = _common.written(values, "values")
    filed = values.select("fp", F.explode(F.array(*_keys(radius, agreeing(values.count(), radius)))).alias("key"))
    large = filed.groupBy("key").count().filter(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("chunks"))
    large = _common.written(large, "large")
    rows = _common.hot_join(filed, large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "fp")
    return _forests(rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b"), radius)


def _rooted(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Return the fingerprints of ``docs``, written, and (node, root) of those that aren't the smallest of their component."""
    marked = _common.written(fingerprints(docs, shingle), "fingerprints")
    return marked, _components.components(near_links(marked.select("fp").distinct(), radius))


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Return doc_id, digest, fp, root (a fingerprint of the component) and component_id of every row of ``docs`` (doc_id, text)."""
    marked, roots_of = _rooted(docs, shingle, radius)
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = nodes.join(roots_of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = _common.written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = _common.hot_join(rooted, least, "root").select("fp", "root", "component_id")
    return _common.hot_join(marked, named, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its fingerprint and the smallest id of its near-duplicates."""
    groups = grouped(_common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Return ``docs`` with one document of each group, that of the smallest id.

    Of different texts with that id in one group, the one of the smallest digest
    stays; rows that repeat id and text count once.
    """
    marked, roots_of = _rooted(docs.select("doc_id", "text"), shingle, radius)
    return heads_of(docs, marked.select("doc_id", "digest", F.col("fp").alias("node")), roots_of)


def heads_of(docs: DataFrame, marked: DataFrame, roots_of: DataFrame) -> DataFrame:
    """Return one document of each group, as ``first_of_each`` says.

    ``marked`` (doc_id, digest of the text, node) has a row for each of ``docs``,
    ``roots_of`` (node, root) for each node that isn't its group's root.  Only
    if more than ``BROADCAST_ROWS`` rows go are texts shuffled.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    least = marked.groupBy("node").agg(first).join(roots_of, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    heads = _common.written(least.select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest")), "heads")
    rows = marked.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.count("*").alias("__n"))
    same = F.col("a.__id").eqNullSafe(F.col("b.__id")) & (F.col("a.__digest") == F.col("b.__digest"))
    losers = _common.written(rows.alias("a").join(heads.alias("b"), same, "left_anti").drop("__n"), "losers")
    repeated = _common.written(rows.filter("__n > 1").alias("a").join(heads.alias("b"), same, "left_semi").drop("__n"), "repeated")
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__digest"))
    few = losers.count() <= _common.BROADCAST_ROWS
    kept = docs.join(F.broadcast(losers), on, "left_anti") if few else docs.join(heads, on, "left_semi")
    if repeated.isEmpty():
        return kept
    repeated = _common.small(repeated)
    return kept.join(repeated, on, "left_anti").unionByName(kept.join(repeated, on, "left_semi").dropDuplicates(["doc_id", "text"]))
