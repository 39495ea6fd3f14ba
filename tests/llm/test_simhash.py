import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from colsense.llm import _components, simhash as S


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows):
    marked = [(i, plain_fingerprint(t)) for i, t in rows]
    fps = sorted({f for _, f in marked})
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            for y in fps:
                if (x ^ y).bit_count() <= 4 and label[x] > label[y]:
                    label[x], changed = label[y], True
    low = {}
    for i, f in marked:
        if i is not None:
            low[label[f]] = min(i, low.get(label[f], i))
    return sorted(((i is None, i or 0, f"{f:016x}", low.get(label[f])) for i, f in marked), key=str)


def test_fingerprint():
    for text in ["", None, " \n", "one", "One TWO three", "a b c d", "a b c d e É é Z " * 50, "x\x0by\x1cz w v", "word " * 70_000]:
        assert S.fingerprint(text) == plain_fingerprint(text)


def test_links_match_brute_force():
    rng = random.Random(1)
    for n in (1, 2, 63, 64, 65, 700):
        base = [rng.getrandbits(64) for _ in range(max(1, n // 7))]
        values = []
        while len(values) < n:
            x = rng.choice(base)
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(64)
            values.append(x)
        for radius in (0, 1, 3, 4, 7):
            i, j = S.links(np.array(values, np.uint64), radius)
            want = {(a, b) for a in range(n) for b in range(a + 1, n) if (values[a] ^ values[b]).bit_count() <= radius}
            assert set(zip(i.tolist(), j.tolist())) == want


def docs_of():
    rng = random.Random(2)
    words = ["w%d" % i for i in range(500)]
    rows, key = [], 100
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 5)):
            mine = list(base)
            for _ in range(rng.randint(0, 1)):
                mine[rng.randrange(len(mine))] = rng.choice(words)
            rows.append((key, " ".join(mine)))
            key -= 1
    return rows + [(500, None), (501, ""), (None, rows[0][1]), (7, rows[0][1]), (7, rows[0][1]), (None, "alone here with some words of its own"), (600, "long " * 40_000)]


def test_groups_match_brute_force(spark, monkeypatch):
    rows = docs_of()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(3)
    for block in (1024, 3):
        monkeypatch.setattr(S, "BLOCK", block)
        got = S.grouped(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
        assert sorted(((r[0] is None, r[0] or 0, r[1], r[2]) for r in got), key=str) == plain_groups(rows)
    kept = S.first_of_each(df).collect()
    heads = {g[3] for g in plain_groups(rows)}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted((h is None, h or 0) for h in heads)
    assert S.grouped(df.limit(0)).count() == 0


def test_near_copies_in_large_block(spark, monkeypatch):
    """A chain of near copies, dealt into many pairs of chunks, stays one component."""
    monkeypatch.setattr(S, "BLOCK", 16)
    values, x = [], 0x0123456789ABCDEF
    for i in range(300):
        x ^= 1 << (i * 7 % 64)
        values.append(x - (x >> 63 << 64))
    nodes = spark.createDataFrame([(v,) for v in set(values)], "fp long")
    found = _components.components(S.near_links(nodes)).collect()
    assert len({r.root for r in found}) == 1 and len(found) == len(set(values)) - 1
