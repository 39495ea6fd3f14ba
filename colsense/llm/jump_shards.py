"""Sharding by jump consistent hashing, with built-in functions only.

A stable key goes to a shard by the published jump walk: a 64-bit linear
congruential generator, seeded by the key, names the next shard count at which
the key would move; the last one below the number of shards is its shard.  No
table of the ring is kept, and one more shard takes rows only into itself.

Law ``key``: the key and the number of shards decide.  The key is XXH64 of the
id.  Slots count from 0 without gaps in each shard: rows are dealt to chunks of
bounded size, chunks get offsets by a running sum of their counts, and rows are
numbered inside a chunk.  The dealt rows (ids, sizes, digests; never texts) are
written to the shared folder first, so that a lost executor can't renumber.

Defined results: a null text has size 1 and CRC 0, like an empty one; a null
id is a key like any other; repeated rows share a shard and get slots of their
own; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsense.llm import _common

#: The multiplier of the published walk, and the rows of a chunk.
MULTIPLIER, CHUNK_ROWS = 2862933555777941757, 32768
#: Jumps are about ln(shards), Poisson-like; past this many the query fails rather than guess.
MOST_JUMPS = 128


def _next_state(key: Column) -> Column:
    """``key * MULTIPLIER + 1`` modulo 2**64 in 16-bit limbs; no product or sum leaves 63 bits."""
    c = [(MULTIPLIER >> s) & 0xFFFF for s in (0, 16, 32, 48)]
    half, limb = F.lit(0xFFFFFFFF), F.lit(0xFFFF)
    low, high = key.bitwiseAND(half), F.shiftrightunsigned(key, 32)
    second = low * c[1]
    lower = low * c[0] + 1 + F.shiftleft(second.bitwiseAND(limb), 16)
    upper = F.shiftrightunsigned(lower, 32) + F.shiftrightunsigned(second, 16) + low * c[2] + F.shiftleft((low * c[3]).bitwiseAND(limb), 16) + high * c[0] + F.shiftleft((high * c[1]).bitwiseAND(limb), 16)
    return F.shiftleft(upper.bitwiseAND(half), 32).bitwiseOR(lower.bitwiseAND(half))


def jump_hash(key: Column, shards: int) -> Column:
    """Return the shard (int, 0 to ``shards`` - 1) of the 64-bit ``key``."""
    if shards < 1:
        raise ValueError("there must be a shard")

    def step(state: Column, _: Column) -> Column:
        moved = _next_state(state["key"])
        jump = ((state["next"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(moved, 33) + 1).cast("double"))).cast("bigint")
        made = F.struct(moved.alias("key"), state["next"].alias("at"), jump.alias("next"))
        return F.when(state["next"] < shards, made).otherwise(state)

    start = F.struct(key.alias("key"), F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"))
    end = lambda s: F.when(s["next"] >= shards, s["at"].cast("int")).otherwise(F.raise_error(F.lit("jump walk too long")).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, step, end)


def assign(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (with one more shard) of column ``key`` (any type)."""
    hashed = F.xxhash64(F.col(key))
    return df.withColumn("shard", jump_hash(hashed, shards)).withColumn("grown_shard", jump_hash(hashed, shards + 1))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).cast("bigint").alias("text_crc32"))
    rows = assign(rows, "doc_id", shards)
    chunks = max(1, math.ceil(docs.count() / CHUNK_ROWS))
    # The running number keeps even a third of all rows with one id apart; it is fixed by the written table.
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(chunks)))
    rows = _common.written(rows, "shards")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "chunk").count().select("shard", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "chunk"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).cast("bigint").alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` in shards 0 to 7, with its slot and its shard among nine."""
    return sharded(_common.table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
