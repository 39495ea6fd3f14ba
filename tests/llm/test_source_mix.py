import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsense.llm import source_mix as M


def plain_vector(text):
    counts = [0] * M.SIZE
    for w in (text or "").split():
        if len(w) >= 5:
            counts[zlib.crc32(w.lower().encode()) % M.SIZE] += 1
    n = sum(counts)
    return [round(c**0.5 * 127 / n**0.5) for c in counts] if n else None


def plain_topics(texts):
    """Topic and words of each text: k-means in whole numbers, one vector at a time."""
    vectors = [plain_vector(t) for t in texts]
    some = [v for v in vectors if v]
    centres = np.rint(np.random.default_rng(M.SEED).normal(size=(M.TOPICS, M.SIZE)) * 64).astype(int).tolist()
    mean = [round(sum(v[d] for v in some) / len(some)) for d in range(M.SIZE)] if some else [0] * M.SIZE

    def topic(v):
        scores = [sum((x - m) * y for x, m, y in zip(v, mean, c)) for c in centres]
        return scores.index(max(scores))

    for _ in range(M.TOPIC_ROUNDS):
        new = []
        for k, c in enumerate(centres):
            away = [sum(v[d] - mean[d] for v in some if topic(v) == k) for d in range(M.SIZE)]
            length = sum(x * x for x in away) ** 0.5
            new.append([round(x * (1024 / length)) for x in away] if length else c)
        centres = new
    return [(topic(v) if v else -1, len((t or "").split())) for v, t in zip(vectors, texts)]


def plain_rake(rows, targets):
    """rows: (source, lang, topic, tokens); returns the weight of each cell after many plain rounds."""
    cells = defaultdict(int)
    for *c, n in rows:
        cells[tuple(c)] += n
    weight = {c: 1.0 for c in cells}
    total = sum(cells.values())
    for _ in range(2000):
        for m in range(3):
            sums, real = defaultdict(float), defaultdict(float)
            for c, n in cells.items():
                sums[c[m]] += n * weight[c]
                real[c[m]] += n
            want = targets[m] or {k: v**0.5 for k, v in real.items()}
            want = {k: want.get(k, 0.0) if real[k] > 0 else 0.0 for k in real}
            whole = sum(want.values())
            for c in cells:
                if want[c[m]] == 0:
                    weight[c] = 0.0
                elif sums[c[m]] > 0:
                    weight[c] *= want[c[m]] / whole * total / sums[c[m]]
    return weight


def some_rows():
    rng = random.Random(6)
    return [(i, rng.choice(["a"] * 6 + ["b", "c", None]), rng.choice(["en", "en", "de", None]), rng.randrange(3), rng.randint(0, 90)) for i in range(400)]


@pytest.mark.parametrize("targets", [{}, {"source": {"a": 0.2, "b": 0.5, "c": 0.1, None: 0.2, "gone": 3.0}, "lang": {"en": 1.0, "de": 1.0}}])
def test_weights(spark, targets):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic int, n_tokens long").withColumn("Weight", F.lit("clash"))
    want = plain_rake([r[1:] for r in rows], [targets.get(m) for m in M.MARGINS])
    for cells in (M.DRIVER_CELLS, 0):
        if not cells and targets:  # distributed rounds are slow here; one case shows that they agree
            continue
        got = M.mixed(docs, targets=targets, driver_cells=cells).collect()
        assert len(got) == len(rows)
        top = max(want.values())
        for r in got:
            w = want[(r.source, r.lang, r.topic)]
            assert np.isclose(r.weight, w, rtol=1e-5) and np.isclose(r.probability, w / top, atol=2e-6)
    again = [{(r.doc_id, r.sampled) for r in M.mixed(docs, driver_cells=cells).collect()} for cells in (M.DRIVER_CELLS, 0)]
    assert targets or again[0] == again[1]


def test_bound_and_budget(spark):
    """One rare cell doesn't shrink the sample; a budget is met in expectation."""
    rows = [(i, "rare" if i == 0 else "hot", "en", 0, 10) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic int, n_tokens long")
    even = {"source": {"rare": 1.0, "hot": 1.0}}
    chance = lambda **more: {r.source: r.probability for r in M.mixed(docs, targets=even, **more).collect()}
    free, bound, half = chance(most=1e9), chance(), chance(budget=0.5)
    assert free["rare"] == bound["rare"] == half["rare"] == 1
    assert np.isclose(free["hot"], 1 / 4999, atol=1e-6) and np.isclose(bound["hot"], 2500 / 4999 / M.MOST, atol=1e-6)
    assert np.isclose(half["rare"] + half["hot"] * 4999, 2500, rtol=1e-3)


def test_topics_group_texts(spark):
    """Texts over different words get different topics, whatever their length and order."""
    rng = random.Random(1)
    pools = ["apple banana cherry grapes orange peach".split(), "engine wheel clutch piston bumper brakes".split()]
    rows = [(i, "s", "en", " ".join(rng.choices(pools[i % 2], k=rng.randint(30, 60)))) for i in range(80)]
    got = M.marked(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")).collect()
    kinds = [{r.topic for r in got if r.doc_id % 2 == k} for k in (0, 1)]
    assert not kinds[0] & kinds[1]
    assert sorted((r.topic, r.n_tokens) for r in got) == sorted(plain_topics([r[3] for r in rows]))


def test_sample_has_shares(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "en" if i % 5 else "de", i % 2, 10) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic int, n_tokens long")
    kept = [r for r in M.mixed(docs).collect() if r.sampled]
    real, mine = defaultdict(float), defaultdict(float)
    for r in rows:
        real[r[1]] += 1
    for r in kept:
        mine[r.source] += 1
    want = {k: v**0.5 / sum(x**0.5 for x in real.values()) for k, v in real.items()}
    assert all(abs(mine[k] / len(kept) - w) < 0.02 for k, w in want.items())


def test_odd_rows(spark):
    texts = [None, "", " \n", "short one", "Longer words stand here, LONGER words indeed", "word " * 40_000 + "lengthy " * 3]
    rows = [(i, "s", None, t) for i, t in enumerate(texts)] + [(None, None, "en", texts[4]), (4, "s", None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumn("TOPIC", F.lit("clash")).withColumn("sampled", F.lit("clash"))
    got = M.marked(docs).collect()
    assert sorted((r.topic, r.n_tokens) for r in got) == sorted(plain_topics([r[3] for r in rows]))
    kept = M.sample(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {r[0] for r in rows}
    assert M.sample(docs.limit(0)).count() == 0 and M.mixed(M.marked(docs.limit(0))).count() == 0
