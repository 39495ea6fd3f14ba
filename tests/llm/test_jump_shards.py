import struct
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from colsense.llm import jump_shards as J


def walk(key, shards):
    at, nxt = -1, 0
    while nxt < shards:
        at = nxt
        key = (key * J.MULTIPLIER + 1) % 2**64
        nxt = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 1000])
def test_walk(spark, shards):
    keys = [0, 1, 2, 3, -1, 2**63 - 1, -(2**63), *range(10**15, 10**15 + 300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for k, got in df.select("k", J.jump_hash(F.col("k"), shards)).collect():
        assert got == walk(k % 2**64, shards)


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK_ROWS", 100)
    rows = [(i, "é" * (i % 7)) for i in range(1000)] + [(None, None), (7, None)] + [(3, "same")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = J.sharded(docs, 8).collect()
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
        if r.doc_id is not None:
            key = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
            assert (r.shard, r.grown_shard) == (walk(key, 8), walk(key, 9))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 700
    assert J.sharded(docs.limit(0), 8).count() == 0
