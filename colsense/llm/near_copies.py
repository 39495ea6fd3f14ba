"""SimHash near-copies down to a given Jaccard similarity: wide bit-sliced comparison, then an exact check.

``simhash`` files fingerprints under pieces of their bits, which works for a
radius of a few bits.  A Jaccard similarity of 0.8 lies at some 10 of 64 bits,
up to about 20, where no such filing is selective.  So fingerprints are filed
under rare shingles instead:

1. Each text becomes the set of hashes of its shingles, and the set gets a
   fingerprint: bit b is set if more than half of the hashes have it.
2. All sets are put in one order, frequent shingles last.  Two sets whose
   similarity reaches 4/5 share a shingle among the first ``n - ceil(4n/5) + 1``
   of each, so a set is filed under these.  How frequent a shingle is, is
   counted over every whole text, in ``BUCKETS`` buckets of hashes; shingles of
   one bucket go by hash.  Any order gives the same pairs.
3. Blocks go through ``simhash.links`` (bit planes, carry-save counters) with
   ``RADIUS``; pairs whose sizes can't reach 4/5 are left out.  A block with
   more than ``PAIRS`` pairs gives one for each member: the neighbour nearest to
   the block's centre.
4. The pairs are confirmed on the whole sets and their components found.
   Where blocks gave only some pairs, all that is near over any number of
   steps is a cluster.  Clusters that still hold members of different
   components are compared again, together with the whole sets, so that only
   links go out: members outside a cluster's largest component against all.  A
   cluster of more than ``LARGE`` sets, or ``LARGE_VALUES`` hashes in them, is
   dealt into pairs of chunks, so that a task's memory has a bound.

Every link is exact, and what is written grows with the input, not with the
square of a group.  A pair is missed only if its fingerprints differ in more than ``RADIUS`` bits, which for
a similarity of 0.8 has a chance of some 1 in 5,000, and falls fast above.

Defined results: words are parted by ASCII white space, A-Z count as a-z; fewer
words than a shingle give one shingle of all; texts without words (null too)
are alike; sets are compared by 32-bit hashes of their shingles.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsense.llm import _common, _components, simhash

SEED, SHINGLE, RADIUS, PAIRS, LARGE, LARGE_VALUES = 42, 5, 20, 64, 8192, 1 << 24
BUCKETS, SLICE = 1 << 18, 1 << 10
TILE, HELD, SALTS, MAP_BYTES, VALUES = 256, 1 << 16, 16, 32 << 20, 1 << 22


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Return the distinct hashes (uint64, sorted) of the shingles of ``text``."""
    import xxhash

    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + n + 1, initial=-1))[1:]
    if len(words) < size:
        parts = [joined]
    else:
        parts = map(joined.__getitem__, map(slice, [0, *[e + 1 for e in ends[: len(words) - size]]], ends[size - 1 :]))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(SEED)), np.uint64))


def _mixed(fp: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Return the number of a set, from its fingerprint and its mark (size and check)."""
    x = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mark.astype(np.uint64)
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _buckets(own: np.ndarray) -> np.ndarray:
    return (own & np.uint64(BUCKETS - 1)).astype(np.int64)


def _frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """Return how many shingles of the texts of all rows, each text's distinct, lie in each of ``BUCKETS`` buckets."""

    def tally(batches):
        total, parts, held = np.zeros(BUCKETS, np.int64), [], 0
        for last, batch in _with_last(batches):
            for text in [] if last else batch.column(0).to_pylist():
                parts.append(_buckets(shingles(text, size)))
                held += len(parts[-1])
                if held >= 4 * BUCKETS:
                    total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
                    parts, held = [], 0
        if parts:
            total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        if total.any():
            yield slices(dict(enumerate(total.reshape(-1, SLICE))))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield slices(sums)

    def slices(found):
        return pa.record_batch([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["slice", "counts"])

    _common.bound_batches(docs.sparkSession)
    kind = "slice int, counts binary"
    out = np.zeros((BUCKETS // SLICE, SLICE), np.int64)
    for row in docs.select("text").mapInArrow(tally, kind).repartition("slice").mapInArrow(add, kind).collect():
        out[row.slice] = np.frombuffer(row["counts"], np.int64)
    return out.ravel()


def _numbers(own: np.ndarray, text: str | None) -> tuple[int, int]:
    """Return the fingerprint of a set of shingles and its mark: its size and 32 bits of its hash."""
    import xxhash

    size = min(len(own), (1 << 31) - 1) << 32
    return simhash.majority(own) if (text or "").strip() else 0, size | xxhash.xxh32_intdigest(own.tobytes(), SEED)


def marked(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Return doc_id, digest (of the text), node (of the set), fp, mark and prefix (hashes in the common order) of each row."""
    often = _frequencies(docs, size)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(text):
        own = shingles(text, size)
        prefix = len(own) + (-4 * len(own)) // 5 + 1
        own_first = own[np.lexsort((own, often[_buckets(own)]))[:prefix]]
        return *_numbers(own, text), own_first.view(np.int64)

    def make(batch: pa.RecordBatch) -> dict:
        made = [one(x) for x in batch.column(1).to_pylist()]
        fp, mark = np.array([m[0] for m in made], np.uint64), np.array([m[1] for m in made], np.int64)
        return {"doc_id": batch.column(0), "digest": batch.column(2), "node": _mixed(fp, mark), "fp": fp.view(np.int64), "mark": mark, "prefix": [m[2] for m in made]}

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return _common.map_batches(rows, make, f"doc_id {kind}, digest bigint, node bigint, fp bigint, mark bigint, prefix array<bigint>")


def _filed(sets: DataFrame) -> DataFrame:
    """Return (gram, fp, mark) for each set under each shingle of its prefix; repeated sets mostly once a task."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            fp, mark, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
            pairs = list(zip(fp.tolist(), mark.tolist()))
            new = []
            for i, key in enumerate(pairs):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if len(seen) > 500_000:
                seen.clear()
            if new:
                lists = lists.take(pa.array(new))
                sizes = np.asarray(lists.value_lengths())
                yield pa.record_batch([lists.flatten(), pa.array(np.repeat(fp[new], sizes)), pa.array(np.repeat(mark[new], sizes))], names=["gram", "fp", "mark"])

    return sets.select("fp", "mark", "prefix").mapInArrow(run, "gram bigint, fp bigint, mark bigint")


def _blocks(batches, least: int) -> Iterator[list[np.ndarray]]:
    """Yield the columns of runs of whole blocks (rows of one first column), of ``least`` rows or more, without blocks of one row."""
    held = None
    for last, batch in _with_last(batches):
        part = [np.asarray(c) for c in batch.columns] if batch is not None else None
        if part is not None:
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
        if held is None or not last and len(held[0]) < least:
            continue
        end = len(held[0])
        if not last:
            end = int(np.searchsorted(held[0], held[0][-1]))  # the last block may go on
        if end:
            run, held = [c[:end] for c in held], [c[end:] for c in held]
            new = np.r_[True, run[0][1:] != run[0][:-1], True]
            some = ~(new[1:] & new[:-1])
            if some.any():
                yield [c[some] for c in run]


def _with_last(batches):
    for batch in batches:
        yield False, batch
    yield True, None


def _near(fp: np.ndarray, mark: np.ndarray, queries: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Return the pairs within ``RADIUS`` whose sizes allow a similarity of 4/5 and which aren't the same set."""
    i, j = simhash.links(fp.view(np.uint64), RADIUS, queries)
    a, b = mark[i] >> 32, mark[j] >> 32
    fine = (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & ((mark[i] != mark[j]) | (fp[i] != fp[j]))
    return i[fine], j[fine]


def _by_centre(block: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Return an order within each block (ascending numbers) that puts the members nearest to the block's majority first."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(block)])
    centre = np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()
    return np.lexsort((np.bitwise_count((fp ^ np.repeat(centre, sizes)).view(np.uint64)), block))


class _Pairs:
    """Pairs of set numbers, each kept once until ``HELD`` of them are there."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            self.n += len(a)

    def taken(self, least: int) -> list[np.ndarray]:
        if self.n < least or not self.n:
            return []
        own = np.unique(np.concatenate(self.parts), axis=0)
        if least and len(own) < least // 2:  # mostly repeats: go on
            self.parts, self.n = [own], len(own)
            return []
        self.parts, self.n = [], 0
        return [own]


def _first_pairs(rows: DataFrame) -> DataFrame:
    """Compare blocks of ``rows`` (gram, fp, mark), sorted; return pairs (a, b) to confirm (kind 0) and pairs that hold together the sets of blocks that aren't done (kind 1)."""

    def emit(kind, own):
        return pa.record_batch([pa.array(np.full(len(own), kind, np.int8)), pa.array(own[:, 0]), pa.array(own[:, 1])], names=["kind", "a", "b"])

    def tiles(run):
        """Cut a run into tiles of small blocks together and large blocks alone."""
        edges = np.r_[0, np.flatnonzero(run[0][1:] != run[0][:-1]) + 1, len(run[0])]
        start = 0
        for at, to in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if to - at > TILE:
                if at > start:
                    yield [c[start:at] for c in run]
                yield [c[at:to] for c in run]
                start = to
            elif to - start > TILE:
                yield [c[start:at] for c in run]
                start = at
        if start < len(run[0]):
            yield [c[start:] for c in run]

    def compare(batches):
        kinds = (_Pairs(), _Pairs())
        for run in _blocks(batches, 1 << 15):
            for gram, fp, mark in tiles(run):
                block = np.r_[0, np.cumsum(gram[1:] != gram[:-1])]
                central = _by_centre(block, fp)
                fp, mark = fp[central], mark[central]
                node = _mixed(fp.view(np.uint64), mark)
                whole = len(gram) <= 4 * TILE or gram[0] != gram[-1]
                step, found = len(gram) if whole else 4 * TILE, []
                for at in range(0, len(gram), step):  # a larger block: for now within each part only
                    i, j = _near(fp[at : at + step], mark[at : at + step])
                    found.append((i + at, j + at))
                i, j = (np.concatenate(x) for x in zip(*found))
                same = gram[i] == gram[j]
                i, j = i[same], j[same]
                many = np.bincount(block[i], minlength=block[-1] + 1) > PAIRS
                if not whole:
                    many[:] = True
                first = np.ones(len(i), bool)
                if many.any():
                    order = np.lexsort((i, j))  # of each later member, its first neighbour
                    first[order] = np.r_[True, j[order][1:] != j[order][:-1]] if len(order) else False
                    first |= ~many[block[i]]
                    if whole:  # what is near, over any number of steps, is one cluster
                        root = simhash.roots(len(node), i, j)
                        child = np.flatnonzero(many[block] & (root != np.arange(len(node))))
                        kinds[1].add(node[child], node[root[child]])
                    else:
                        kinds[1].add(node[1:], np.full(len(node) - 1, node[0]))
                kinds[0].add(node[i[first]], node[j[first]])
                for kind, pairs in enumerate(kinds):
                    for own in pairs.taken(HELD):
                        yield emit(kind, own)
        for kind, pairs in enumerate(kinds):
            for own in pairs.taken(0):
                yield emit(kind, own)

    return rows.mapInArrow(compare, "kind tinyint, a bigint, b bigint")


def _overlaps(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Return how many values sets i and j of ``lists`` (int32, sorted, distinct) share, for each pair, by ranges of some ``VALUES`` values."""
    rows, places = np.unique(np.r_[i, j], return_inverse=True)
    i, j = places[: len(i)], places[len(i) :]
    own = [lists[r] for r in rows]
    cuts = np.linspace(-(1 << 31), 1 << 31, 2 + sum(map(len, own)) // VALUES).astype(np.int64)
    ends = [np.searchsorted(x, cuts) for x in own]
    both = np.zeros(len(i), np.int64)
    for k in range(len(cuts) - 1):
        both += _shared([x[e[k] : e[k + 1]] for x, e in zip(own, ends)], i, j)
    return both


def _shared(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Return how many values sets i and j of ``lists`` share, for each pair, by bit maps of bounded size."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, value, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1  # values of one set only can't be shared
    some = counts[value] > 1
    owner, value = owner[some], number[value[some]]
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    both, width = np.zeros(len(i), np.int64), max(64, (MAP_BYTES // len(lists)) // 64 * 64)
    for low in range(0, int(value[-1]) + 1 if len(value) else 0, width):
        at, to = np.searchsorted(value, [low, low + width])
        bits = np.zeros((len(lists), min(width, -(-(int(value[to - 1]) + 1 - low) // 64) * 64)), bool)
        bits[owner[at:to], value[at:to] - low] = True
        maps = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, MAP_BYTES // (8 * maps.shape[1]))
        for k in range(0, len(i), step):
            both[k : k + step] += np.bitwise_count(maps[i[k : k + step]] & maps[j[k : k + step]]).sum(axis=1, dtype=np.int64)
    return both


def _joining(fp: np.ndarray, mark: np.ndarray, tree: np.ndarray, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Return places (i, j), at most one for each, that join the trees of one block's sets where sets of different trees are similar."""
    label = np.unique(tree, return_inverse=True)[1]
    names = label.copy()
    largest = np.bincount(label).argmax()
    order = np.argsort(label == largest, kind="stable")  # the largest tree's members only answer
    sizes = np.array([len(x) for x in lists])
    for at in range(0, int((label != largest).sum()), TILE):
        part = order[at:]
        i, j = _near(fp[part], mark[part], min(TILE, int((label[part] != largest).sum())))
        i, j = part[i], part[j]
        apart = names[i] != names[j]
        i, j = i[apart], j[apart]
        if len(i):
            close = 9 * _overlaps(lists, i, j) >= 4 * (sizes[i] + sizes[j])
            names = simhash.roots(int(names.max()) + 1, names[i[close]], names[j[close]])[names]
    first = np.full(int(names.max()) + 1, len(label))
    np.minimum.at(first, names, np.arange(len(label)))
    i, one = np.arange(len(label)), np.unique(label, return_index=True)[1]  # one member of each tree says where it went
    i = i[one][label[first[names[one]]] != label[one]]
    return i, first[names[i]]


def _inner_links(rows: DataFrame) -> DataFrame:
    """Return links (u, v) that join the trees of clusters of ``rows``, sorted by (cluster, a, b): all near pairs of a cluster are compared exactly."""

    def work(table: pa.Table):
        if not table.num_rows:
            return
        cluster, a, b, fp, mark, node, tree = (table.column(k).combine_chunks().to_numpy() for k in range(7))
        sets = table.column(7).combine_chunks()
        ends, flat = np.asarray(sets.offsets), np.asarray(sets.values)
        new = (cluster[1:] != cluster[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        edges = np.r_[0, np.flatnonzero(new) + 1, len(cluster)]
        for at, to in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = at + np.unique(node[at:to], return_index=True)[1]
            if (tree[own] != tree[own[0]]).any():
                i, j = _joining(fp[own], mark[own], tree[own], [flat[ends[k] : ends[k + 1]] for k in own])
                if len(i):
                    yield pa.record_batch([pa.array(node[own[i]]), pa.array(node[own[j]])], names=["u", "v"])

    def run(batches):
        held = None
        for last, batch in _with_last(batches):
            if batch is not None:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
            if held is None or not held.num_rows:
                continue
            end = held.num_rows
            if not last:
                keys = [held.column(k).combine_chunks().to_numpy() for k in range(3)]
                same = np.logical_and.reduce([k == k[-1] for k in keys])
                end = int(np.argmax(same))  # the last block may go on
            yield from work(held.slice(0, end))
            held = held.slice(end)

    return rows.select("cluster", "a", "b", "fp", "mark", "node", "tree", "grams").mapInArrow(run, "u bigint, v bigint")


def _sets(docs: DataFrame, marks: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Return (node, fp, mark, grams), written: the whole set of each of ``nodes`` and its numbers."""
    texts = _common.written(marks.join(_common.small(nodes), "node", "left_semi").groupBy("node").agg(F.min("digest").alias("digest")), "texts")
    # Copies of a text are brought together in the tasks that read them, so a hot text isn't sent many times.
    rows = docs.select(F.xxhash64("text").alias("digest"), "text").join(_common.small(texts), "digest").groupBy("node").agg(F.first("text").alias("text"))

    def make(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        sets = [shingles(x, size) for x in texts]
        numbers = np.array([_numbers(*x) for x in zip(sets, texts)], np.uint64)
        return {"node": batch.column(0), "fp": numbers[:, 0].copy().view(np.int64), "mark": numbers[:, 1].astype(np.int64), "grams": [np.unique(x.astype(np.uint32).view(np.int32)) for x in sets]}

    made = _common.map_batches(rows, make, "node bigint, fp bigint, mark bigint, grams array<int>")
    out = _common.written(made, "sets")
    _common.discard(texts)
    return out


def _confirmed(docs: DataFrame, marks: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Return the pairs (u, v) of ``pairs`` (a, b) whose sets' similarity reaches 4/5, written."""
    pairs = _common.written(pairs.select("a", "b").distinct(), "pairs")
    nodes = _common.written(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    sets = _sets(docs, marks, nodes, size)
    joined = pairs
    for side, hot in [(side, _common.hot_keys(pairs, side)) for side in ("a", "b")]:  # a set with very many pairs goes to several tasks
        salt = F.when(F.col(side).isin(hot), F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int")).otherwise(0)
        salts = F.when(F.col("node").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        own = sets.select(F.col("node").alias(side), F.col("grams").alias(f"grams_{side}"), F.explode(salts).alias("salt"))
        joined = joined.withColumn("salt", salt).join(own, [side, "salt"]).drop("salt")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    close = joined.filter(9 * both >= 4 * (F.size("grams_a") + F.size("grams_b")))
    out = _common.written(close.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    _common.discard(pairs, nodes, sets)
    return out


def roots(docs: DataFrame, marks: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Return (node, root) for the sets of ``docs`` that aren't the smallest number of their group; ``marks`` is ``marked``, written."""
    filed = _filed(marks).repartition("gram").sortWithinPartitions("gram")
    first = _common.written(_first_pairs(filed), "compared")
    links = _confirmed(docs, marks, first.filter("kind = 0"), size)
    found = _components.components(links)
    held = _common.written(first.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "held")
    named = _components.components(held).withColumnRenamed("root", "cluster")
    nodes = held.select(F.col("u").alias("node")).unionAll(held.select(F.col("v").alias("node"))).distinct()
    rows = nodes.join(named, "node", "left").join(found, "node", "left")
    rows = _common.written(rows.select("node", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("root", "node").alias("tree")), "clusters")
    blocks = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.min("tree").alias("low"), F.max("tree").alias("high")).filter("low <> high")
    blocks = _common.written(blocks.select("cluster", F.ceil(F.col("n") / LARGE).cast("int").alias("chunks")), "blocks")
    if blocks.isEmpty():
        return found
    left_open = _common.written(_common.hot_join(rows, blocks, "cluster"), "open")
    sets = _sets(docs, marks, left_open.select("node"), size)
    sizes = left_open.join(sets.select("node", F.shiftright("mark", 32).alias("size")), "node").groupBy("cluster").agg(F.max("chunks").alias("chunks"), F.sum("size").alias("values"))
    sizes = _common.written(sizes.select("cluster", F.greatest("chunks", F.ceil(F.col("values") / LARGE_VALUES).cast("int")).alias("chunks")), "blocks")
    left = _common.hot_join(left_open.drop("chunks"), sizes, "cluster")
    left = left.withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    left = left.select("cluster", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "node", "tree").join(sets, "node")
    more = _common.written(_inner_links(left.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")), "links")
    _common.discard(first, held, rows, blocks, sizes, left_open, sets)
    return found if more.isEmpty() else _components.components(links.unionAll(more))


def first_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Return ``docs`` with one document of each group of near-copies, that of the smallest id (see ``simhash.heads_of``)."""
    texts = docs.select("doc_id", "text")
    marks = _common.written(marked(texts, size), "prefixes")
    return simhash.heads_of(docs, marks.select("doc_id", "digest", "node"), roots(texts, marks, size))
