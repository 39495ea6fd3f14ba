import random
import tracemalloc
from collections import defaultdict

import numpy as np

import corpus_pipeline
from colsense.llm import near_copies, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_heads(rows):
    """Smallest id of each component of 5-word Jaccard similarity >= 0.8, every pair compared."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = defaultdict(list)
    for x, (i, _) in zip(label, rows):
        ids[x].append(i)
    return sorted(min(v) for v in ids.values())


def edited_docs():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    line = " ".join(rng.choices(words, k=30))  # common to many texts
    rows, key = [], 1000
    for g in range(30):
        base = rng.choices(words, k=rng.randint(3, 150)) + (line.split() if g % 3 == 0 else [])
        for _ in range(rng.randint(1, 8)):
            mine = list(base)
            for _ in range(rng.randint(0, 4)):
                mine[rng.randrange(len(mine))] = rng.choice(words)
            rows.append((key, " ".join(mine)))
            key -= 1
    return rows + [(1, None), (2, " "), (3, ""), (4, rows[0][1].upper()), (4, rows[0][1].upper())]


def test_stage_links_every_edited_copy(spark):
    rows = edited_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.unique(spark, docs, None).collect())
    assert got == plain_heads(rows)
    assert len(got) < simhash.first_of_each(docs).count()
    assert corpus_pipeline.unique(spark, docs.limit(0), None).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.unique(spark, docs, None).collect())
    assert got == plain_heads([(r.doc_id, r.text) for r in docs.collect()])


def test_overlaps_in_bounded_memory():
    """Sets of long texts are compared in less memory than several times their own size."""
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**31), 2**31, 20_000).astype(np.int32)
    lists = [np.unique(np.r_[base[rng.random(len(base)) < 0.9], np.int32([-(2**31), 2**31 - 1])]) for _ in range(800)]
    i, j = np.arange(799), np.arange(1, 800)
    tracemalloc.start()
    got = near_copies._overlaps(lists, i, j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [len(np.intersect1d(lists[a], lists[b])) for a, b in zip(i, j)]
    assert peak < 4 * sum(x.nbytes for x in lists)


def test_cluster_is_dealt_by_the_size_of_its_sets(spark, monkeypatch):
    """A few sets of many values are dealt into chunks too, and no link is lost."""
    rng = random.Random(5)
    words = ["w%d" % i for i in range(3000)]
    base, rows = rng.choices(words, k=300), []
    for key in range(80):
        mine = list(base)
        for _ in range(rng.randint(2, 5)):
            mine[rng.randrange(len(mine))] = rng.choice(words)
        rows.append((key, " ".join(mine)))
    pairs, plain = [], near_copies._inner_links

    def spied(table):
        pairs.append({(r.a, r.b) for r in table.select("a", "b").distinct().collect()})
        return plain(table)

    monkeypatch.setattr(near_copies, "_inner_links", spied)
    monkeypatch.setattr(near_copies, "LARGE_VALUES", 5000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.unique(spark, docs, None).collect())
    assert got == plain_heads(rows)
    assert any((0, 1) in x for x in pairs)


def test_every_shingle_of_every_text_is_counted(spark):
    """A passage that many texts hold far from their start comes last in the order, in whatever rows it lies."""
    passage = " ".join(f"shared{i}" for i in range(100))
    rows = [(k, " ".join(f"own{k}word{i}" for i in range(1500)) + " " + passage) for k in range(40)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    common = set(near_copies.shingles(passage).view(np.int64).tolist())
    for row in near_copies.marked(docs).filter("doc_id < 40").collect():
        assert len(row.prefix) == 320 and not common & set(row.prefix)
    want = sum(len(near_copies.shingles(text)) for _, text in rows)
    assert near_copies._frequencies(docs, 5).sum() == want
    assert not near_copies._frequencies(docs.limit(0), 5).any()
