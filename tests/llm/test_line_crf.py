import itertools
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsense.llm import line_crf as C

CLEAN = "The line says a few plain things in order.\nAnd so does the next one, with a stop at its end."
JUNK = "ALL!! OF!! IT!! SHOUTS!!\nAnd### then$$$ some%%%"


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([1, 4, 2, 6])
    made = rng.normal(size=(counts.sum(), 3))
    chain = C.Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    good, steps, total = chain.marginals(made, counts)
    at, want_steps = 0, np.zeros((2, 2))
    for d, n in enumerate(counts):
        weights = {}
        for labels in itertools.product((0, 1), repeat=n):
            value = sum(made[at + t] @ chain.weight for t in range(n) if labels[t]) + sum(chain.step[a, b] for a, b in zip(labels, labels[1:]))
            weights[labels] = np.exp(value)
        z = sum(weights.values())
        assert np.isclose(np.log(z), total[d])
        for t in range(n):
            assert np.isclose(good[at + t], sum(w for k, w in weights.items() if k[t]) / z)
        for labels, w in weights.items():
            for a, b in zip(labels, labels[1:]):
                want_steps[a, b] += w / z
        at += n
    assert np.allclose(steps, want_steps)


def test_neighbours_stay_in_document():
    rows = np.arange(1.0, 6.0)[:, None]
    made = C.features(rows, np.array([2, 1, 2]))
    assert made.tolist() == [[1, 0, 2], [2, 1, 0], [3, 0, 0], [4, 0, 5], [5, 4, 0]]


def test_odd_rows(spark):
    rows = [(i, CLEAN if i % 2 else JUNK) for i in range(60)] + [(100, None), (101, ""), (None, CLEAN), (1, CLEAN), (102, "word\n" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    chain = C.train(docs, labels)
    got = C.score(docs, chain).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        if r.text in (CLEAN, JUNK):
            assert (r.score >= C.THRESHOLD) == (r.text == CLEAN)
    kept = C.accepted(docs, chain)
    assert kept.columns == docs.columns and {r[2] for r in kept.collect()} == {"clash"}
    assert C.train(docs, labels.limit(0)).scores([CLEAN, None]).tolist() == [0.5, 0.5]
    assert C.score(docs.limit(0), chain).count() == 0
    out = {r[0] for r in docs.filter(C.held_out(F.col("doc_id"))).collect()}
    assert out == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = C.query(spark, sf).filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 50 and sum(r[0] == r[1] for r in rows) / len(rows) > 0.97


def test_lines_of_a_mixed_document(spark):
    """Good and bad lines in one document get their own labels; documents carry only one."""
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(200)]
    good = lambda: " ".join(rng.choice(words, 9)).capitalize() + "."
    bad = lambda: " | ".join(rng.choice(words, 7))
    rows = [(i, "\n".join((good if i % 3 or rng.random() < 0.5 else bad)() for _ in range(8)) + ("" if i % 3 else "\n" + bad()), int(bool(i % 3))) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    chain = C.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    kinds = [1, 1, 1, 0, 0, 0, 1, 1, 0, 1]
    made, _ = C.measures("\n".join((good if k else bad)() for k in kinds))
    labels = chain.marginals(C.features(np.array(made), np.array([len(kinds)])), np.array([len(kinds)]))[0] >= 0.5
    assert labels.astype(int).tolist() == kinds


def test_gradient_of_latent_labels():
    """The likelihood over agreeing label sequences, by enumeration, against the weights that the fit uses."""
    rng = np.random.default_rng(3)
    counts, labels = np.array([3, 1, 4]), np.array([1, 0, 0])
    made = rng.normal(size=(counts.sum(), 2))
    chain = C.Chain(rng.normal(size=2), rng.normal(size=(2, 2)))
    total, best = chain.marginals(made, counts)[2], chain.all_good(made, counts)
    at = 0
    for d, n in enumerate(counts):
        weights = {k: np.exp(sum(made[at + t] @ chain.weight for t in range(n) if k[t]) + sum(chain.step[a, b] for a, b in zip(k, k[1:]))) for k in itertools.product((0, 1), repeat=int(n))}
        agree = weights[(1,) * n] if labels[d] else sum(w for k, w in weights.items() if 0 in k)
        mine = best[d] - total[d] if labels[d] else np.log1p(-np.exp(best[d] - total[d]))
        assert np.isclose(np.log(agree / sum(weights.values())), mine)
        at += n


def test_one_id_in_a_third_of_the_rows(spark):
    rows = [(1, f"{CLEAN}\nNumber {i}.") for i in range(3000)] + [(i + 2, CLEAN if i % 2 else JUNK) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(i + 2, i % 2) for i in range(200)], "doc_id long, quality int")
    seen, fit = [], C.fit
    try:
        C.fit = lambda rows, counts, sizes, labels: seen.append(len(counts)) or fit(rows, counts, sizes, labels)
        assert C.train(docs, labels, sample=500).scores([CLEAN])[0] > 0.5
    finally:
        C.fit = fit
    assert seen and seen[0] <= 500


def test_scoring_holds_few_lines():
    """A batch of texts of very many short lines is scored in bounded memory, each as alone."""
    rng = np.random.default_rng(0)
    chain = C.Chain(rng.normal(size=3 * C.MEASURES), rng.normal(size=(2, 2)), 0.7, 0.2)
    texts = [None, "", CLEAN, JUNK] + ["\n".join(f"w{k}x{i}." for i in range(20_000)) for k in range(10)]
    tracemalloc.start()
    got = chain.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * 200_000
    for text, score in [*zip(texts[:5], got), (texts[-1], got[-1])]:
        rows, sizes = C.measures(text)
        made = C.features(np.array(rows), np.array([len(rows)]))
        mean = chain.mean(made, np.array([len(rows)]), np.array(sizes))
        assert np.allclose(score, C._logistic(chain.slope * C._logit(mean) + chain.offset))
