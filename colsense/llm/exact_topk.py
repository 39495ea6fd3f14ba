"""Exact top-k inner-product search by distributed histogram selection.

Queries are packed into blocks and written to the shared folder.  Every task
holds a chunk of its vectors and reads the blocks one after another, scoring
its chunk against each.  Scores are never kept: each pass counts them in a
histogram per query over a range known to hold the kth score, the histograms
are summed, and the bucket with the kth score becomes the next range, until it
is one score wide.  A last pass keeps what reaches the kth score and breaks
ties by id.  There is one pass for each level of the histogram, for any number
of queries.

Bounds: a block has at most ``BLOCK`` queries, a chunk at most ``CHUNK_BYTES``;
for a chunk and a query a task sends the top buckets that hold the chunk's own k
best scores (the kth of all can't lie lower), and at the end its k best rows.
Nothing of the queries comes to the driver, so any number of rows may share an
id.  Blocks are read through pyarrow's file systems, so the shared folder must
be one of theirs.

Defined results: components become floor(256 * x); a vector takes part if it is
not null, all its components are finite, and its id is not null.  Rows with the
query's id are its own and never its candidates.  Vectors of another length
than the query's aren't scored.  Repeated query rows each get their result.
Scores beyond 64 bits are an error.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsense.llm import _common

BLOCK, BUCKETS, SCALE, CHUNK_BYTES, TILE = 4096, 512, 256.0, 64 << 20, 1024
PACKED = "block bigint, size int, ids binary, vectors binary, low binary, width binary, need binary"


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (ids, float64 matrix of whole numbers), by vector length."""
    lists = batch.column(1)
    lengths = np.asarray(lists.value_lengths().fill_null(-1)) if len(lists) else np.zeros(0, int)
    ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    ends = np.cumsum(np.maximum(lengths, 0))
    for size in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero((lengths == size) & valid)
        made = flat[(ends[rows] - size)[:, None] + np.arange(size)]
        fine = np.isfinite(made).all(axis=1)
        if fine.any():
            yield ids[rows[fine]], np.floor(SCALE * made[fine])


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Return the exact inner products of whole-number rows, as int64."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    most = np.abs(left).max() * np.abs(right).max() * left.shape[1]
    if most < 2.0**53:  # every partial sum is a whole number that a double holds
        return (left @ right.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in left], object) @ np.array([[int(x) for x in row] for row in right], object).T
    return exact.astype(np.int64)


def _packed(queries: DataFrame, reach: float, k: int) -> DataFrame:
    """Return blocks of ``queries``, each of one vector length, with every query's first range: all scores it can have."""

    schema = _common.arrow_schema(PACKED)

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(parts):
            nonlocal made
            ids, vectors = (np.concatenate(x) for x in zip(*parts))
            bound = np.ceil(np.sqrt((vectors * vectors).sum(axis=1)) * reach).astype(np.int64) + 1
            made += 1
            row = {"block": (task << 32) + made, "size": vectors.shape[1], "ids": ids.astype(np.int64).tobytes(), "vectors": vectors.tobytes(), "low": (-bound).tobytes(), "width": (2 * bound + 1).tobytes(), "need": np.full(len(ids), k).tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for ids, vectors in _vectors(batch):
                parts = held.setdefault(vectors.shape[1], [])
                for at in range(0, len(ids), BLOCK):
                    if sum(len(i) for i, _ in parts) + len(ids[at : at + BLOCK]) > BLOCK:
                        yield block(parts)
                        parts.clear()
                    parts.append((ids[at : at + BLOCK], vectors[at : at + BLOCK]))
        for parts in held.values():
            if parts:
                yield block(parts)

    return queries.mapInArrow(run, PACKED)


class _Block:
    """The queries of one block, with their ranges."""

    def __init__(self, row: dict):
        self.number, self.size = row["block"], row["size"]
        self.ids, self.low, self.width, self.need = (np.frombuffer(row[c], np.int64) for c in ("ids", "low", "width", "need"))
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), self.size)

    def scores(self, chunk: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Yield (candidate ids, scores, whether a candidate)."""
        for ids, vectors in chunk:
            if vectors.shape[1] == self.size:
                yield ids, _product(self.vectors, vectors), self.ids[:, None] != ids[None, :]


def _blocks(files: list[str]) -> Iterator[_Block]:
    """Read the written blocks, one at a time."""
    import pyarrow.fs
    import pyarrow.parquet

    for name in files:
        system, path = pyarrow.fs.FileSystem.from_uri(name)
        with system.open_input_file(path) as source:
            for batch in pyarrow.parquet.ParquetFile(source).iter_batches(1):
                yield from (_Block(row) for row in batch.to_pylist())


def _chunks(batches) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Yield lists of at most some ``CHUNK_BYTES`` of vectors, in tiles of at most ``TILE`` rows of one length."""
    chunk, size = [], 0
    for batch in batches:
        for ids, vectors in _vectors(batch):
            for at in range(0, len(ids), TILE):
                chunk.append((ids[at : at + TILE], vectors[at : at + TILE]))
            size += vectors.nbytes
        if size > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _top_buckets(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Return the (query, bucket) pairs, from the top of each query's histogram, that hold its k highest."""
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
    return np.nonzero((counts > 0) & (above < k))


def _histograms(vectors: DataFrame, files: list[str], k: int) -> DataFrame:
    def run(batches):
        for chunk in _chunks(batches):
            for block in _blocks(files):
                if (block.width <= 1).all():
                    continue
                bucket_size = -(-block.width // BUCKETS)
                counts = np.zeros((len(block.ids), BUCKETS), np.int64)
                number = np.arange(len(block.ids))[:, None] * BUCKETS
                for _, scores, real in block.scores(chunk):
                    above = scores - block.low[:, None]
                    real = real & (above >= 0) & (above < block.width[:, None])
                    counts += np.bincount((number + above // bucket_size[:, None])[real], minlength=counts.size).reshape(counts.shape)
                q, b = _top_buckets(counts, k)
                yield pa.record_batch([pa.array(np.full(len(q), block.number)), pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b], pa.int64())], names=["block", "q", "bucket", "n"])

    return vectors.mapInArrow(run, "block bigint, q int, bucket int, n bigint").groupBy("block", "q", "bucket").agg(F.sum("n").alias("n"))


def _narrowed(key, left, right):
    """Return a block (one row of ``left``) with each query's range cut to the bucket, of ``right``, that holds its kth score."""
    if not left.num_rows:
        return left
    row = left.to_pylist()[0]
    block = _Block(row)
    counts = np.zeros((len(block.ids), BUCKETS), np.int64)
    counts[np.asarray(right.column("q")), np.asarray(right.column("bucket"))] = np.asarray(right.column("n"))
    width, rows = -(-block.width // BUCKETS), np.arange(len(block.ids))
    from_top = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    bucket = BUCKETS - 1 - (from_top[:, ::-1] >= block.need[:, None]).argmax(axis=1)
    enough, open_ = from_top[:, 0] >= block.need, block.width > 1
    need = np.where(open_ & enough, block.need - (from_top[rows, bucket] - counts[rows, bucket]), block.need)
    low = np.where(open_ & enough, block.low + bucket * width, block.low)  # with fewer than k candidates all are taken
    row |= {"low": low.tobytes(), "width": np.where(open_ & enough, width, 1).tobytes(), "need": need.tobytes()}
    return pa.Table.from_pylist([row], schema=left.schema)


def _reaching(vectors: DataFrame, files: list[str], k: int) -> DataFrame:
    def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.arange(0)
        return q[place < k], ids[place < k], scores[place < k]

    def run(batches):
        for chunk in _chunks(batches):
            for block in _blocks(files):
                kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                for ids, scores, real in block.scores(chunk):
                    i, j = np.nonzero(real & (scores >= block.low[:, None]))
                    kept = best(np.r_[kept[0], i], np.r_[kept[1], ids[j]], np.r_[kept[2], scores[i, j]])
                yield pa.record_batch([pa.array(np.full(len(kept[0]), block.number)), pa.array(kept[0], pa.int32()), pa.array(block.ids[kept[0]], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.int64())], names=["block", "q", "query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "block bigint, q int, query_id bigint, vec_id bigint, score bigint")


def _wide(blocks: DataFrame) -> bool:
    """Tell whether any query's range is still wider than one score."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([bool((np.frombuffer(x, np.int64) > 1).any()) for x in batch.column(0).to_pylist()])], names=["wide"])

    return not blocks.select("width").mapInArrow(run, "wide boolean").filter("wide").isEmpty()


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK) -> DataFrame:
    """Return query_id, rank, vec_id and score of the k best of ``vectors`` for each row of ``queries``.

    Both have columns vec_id (long) and embedding (array of float or double).
    """
    spark = vectors.sparkSession
    _common.bound_batches(spark)
    vectors, queries = vectors.select("vec_id", "embedding"), queries.select("vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    whole = lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("double")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + whole(x) * whole(x)))
    reach = (vectors.filter(valid).agg(F.max(norm)).head()[0] or 0.0) * (1 + 1e-9)
    queries = queries.filter(valid)
    longest, n = queries.agg(F.max(norm), F.count("*")).head()
    if (longest or 0.0) * reach >= 2.0**61:
        raise ValueError("scores may leave 64 bits")
    parts = max(1, -(-n // block_rows))
    blocks = _common.written(_packed(queries.repartition(parts), reach, k), "queries")
    while _wide(blocks):
        counted = _histograms(vectors, list(blocks.inputFiles()), k)
        narrowed = blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_narrowed, PACKED)
        blocks, old = _common.written(narrowed.repartition(parts), "queries"), blocks
        _common.discard(old)
    rows = _reaching(vectors, list(blocks.inputFiles()), k)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best for every vector of ``embeddings`` whose id is divisible by 50."""
    vectors = _common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""
