"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  The cells' token
counts are raked: scaled to each margin's target shares in turn, again and
again, until all margins hold.  A cell's raked over its real tokens is the
weight of its documents, 1 on average over tokens.  Weights over the largest
are probabilities, and a document is sampled if a hash of its id, as a number
from 0 to 1, is below its own.  So the sample's expected tokens have the target
shares.  Weights above ``MOST`` count as that, lest a rare cell shrink the whole
sample; with a budget (a share of all tokens) weights are scaled so that the
expected tokens come to it.  Where a probability would pass 1, a cell's
documents all stay and its share falls short.

Cells are counted first.  Up to ``DRIVER_CELLS`` of them are raked on the driver
and joined by broadcast; beyond that, factors for each margin are raked by
distributed sums and joined by shuffles that may split large keys.

Topic: where documents have none, a text's words of five letters or more are
hashed to a vector of square roots of counts, and the corpus is parted by
k-means in direction from the mean, over all rows, from seeded centres.  All is
in whole numbers, so the order of tasks can't matter.  Tokens are the words
between white space.

Defined results: null is a category like any other; a text without long words
(null too) has topic -1; of equally near centres the first; targets are shares of the categories that have tokens, others
are left out and the rest scaled up; a cell without tokens has its margins'
factors as weight; margins that can't all hold end after ``ROUNDS`` rounds at
the last fit; repeated rows are decided alike; other columns are kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.llm import _common

MARGINS, POWER, MOST = ("source", "lang", "topic"), 0.5, 20.0
TOPICS, SIZE, LONG_WORD, TOPIC_ROUNDS = 8, 64, 5, 6
DRIVER_CELLS, ROUNDS, CLOSE, SEED = 100_000, 200, 1e-9, 17


class _Places(dict):
    """Where a word counts in a text's vector; short words count nowhere."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        at = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % SIZE if len(word) >= LONG_WORD else SIZE
        if len(word) < 32:
            self[word] = at
        return at


_PLACE_OF = _Places()


def vector_and_tokens(text: str | None) -> tuple[np.ndarray | None, int]:
    """Return the hashed word vector of ``text`` (whole numbers; None without long words) and its number of words."""
    words = (text or "").split()
    counts = np.bincount(np.fromiter(map(_PLACE_OF.__getitem__, words), np.int64, len(words)), minlength=SIZE + 1)[:SIZE]
    if not counts.any():
        return None, len(words)
    root = np.sqrt(counts)
    return np.rint(root * (127 / np.sqrt(counts.sum()))).astype(np.int8), len(words)


def nearest(vectors: np.ndarray, mean: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Return the centre nearest to each row in direction, both taken from ``mean``; whole numbers, so rounding can't decide."""
    scores = vectors.astype(np.int64) @ centres.T - centres @ mean
    return scores.argmax(axis=1)


def _sums(vectors: DataFrame, mean: np.ndarray | None, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return, for each centre, the number and the sum of the vectors nearest to it (of all, if there is no mean yet)."""

    def add(batches):
        n, total = np.zeros(TOPICS, np.int64), np.zeros((TOPICS, SIZE), np.int64)
        for batch in batches:
            made = _matrix(batch.column(0))
            at = nearest(made, mean, centres) if mean is not None else np.zeros(len(made), int)
            n += np.bincount(at, minlength=TOPICS)
            for t in np.unique(at):
                total[t] += made[at == t].sum(axis=0, dtype=np.int64)
        k, d = np.divmod(np.arange(TOPICS * SIZE), SIZE)
        yield pa.record_batch([pa.array(k), pa.array(d), pa.array(total.ravel()), pa.array(n[k])], names=["k", "d", "total", "n"])

    sums, counts = np.zeros((TOPICS, SIZE), np.int64), np.zeros(TOPICS, np.int64)
    found = vectors.filter("vector IS NOT NULL").select("vector").mapInArrow(add, "k bigint, d bigint, total bigint, n bigint")
    for k, d, total, n in found.groupBy("k", "d").agg(F.sum("total"), F.sum("n")).collect():  # TOPICS * SIZE rows
        sums[k, d], counts[k] = total, n
    return counts, sums


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, SIZE)


def topics(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Return the mean and the centres of ``vectors`` (vector binary): k-means in direction over all rows, from seeded centres."""
    centres = np.rint(np.random.default_rng(SEED).normal(size=(TOPICS, SIZE)) * 64).astype(np.int64)
    counts, sums = _sums(vectors, None, centres)
    n = int(counts.sum())
    if not n:
        return np.zeros(SIZE, np.int64), centres
    mean = np.rint(sums.sum(axis=0) / n).astype(np.int64)
    for _ in range(TOPIC_ROUNDS):
        counts, sums = _sums(vectors, mean, centres)
        away = sums - counts[:, None] * mean
        length = np.sqrt((away.astype(float) ** 2).sum(axis=1, keepdims=True))
        new = np.where(length > 0, np.rint(away * (1024 / np.where(length > 0, length, 1.0))), centres).astype(np.int64)
        if (new == centres).all():
            break
        centres = new
    return mean, centres


def marked(docs: DataFrame, topic: str = "topic", tokens: str = "n_tokens", text: str = "text") -> DataFrame:
    """Return ``docs`` with columns ``topic`` (int) and ``tokens`` (bigint) of column ``text``, which goes; they replace others of those names.

    What is returned is read from a written table, so each text is looked at once.
    """

    @F.pandas_udf("vector binary, tokens bigint")
    def found(x):
        import pandas as pd

        made = [vector_and_tokens(v if isinstance(v, str) else None) for v in x]
        return pd.DataFrame({"vector": pd.Series([None if v is None else v.tobytes() for v, _ in made], dtype=object), "tokens": [n for _, n in made]})

    _common.bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in (topic.lower(), tokens.lower()) and c != text]
    rows = docs.withColumn("__marks", found(F.col(text))).select(*kept, F.col("__marks.vector").alias("__vector"), F.col("__marks.tokens").alias(tokens))
    rows = _common.written(rows, "marked")
    mean, centres = topics(rows.select(F.col("__vector").alias("vector")))

    @F.pandas_udf("int")
    def topic_of(x):
        import pandas as pd

        some = np.array([v is not None for v in x], bool)
        out = np.full(len(x), -1)
        if some.any():
            out[some] = nearest(np.frombuffer(b"".join(v for v in x if v is not None), np.int8).reshape(-1, SIZE), mean, centres)
        return pd.Series(out)

    return rows.select(*kept, topic_of("__vector").alias(topic), tokens)


def _shares(sums: np.ndarray, categories: list, target: dict | None, power: float) -> np.ndarray:
    """Return the target shares of ``categories`` among those with tokens: given ones, else the tokens' ``power``."""
    want = np.array([max(0.0, float(target.get(c, 0.0))) for c in categories]) if target is not None else np.power(sums, power)
    want = np.where(sums > 0, want, 0.0)
    return want / want.sum() if want.sum() > 0 else want


def rake(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> list[np.ndarray]:
    """Return each margin's factors, so that tokens times factors has each margin's ``shares``."""
    factors = [np.where(s > 0, 1.0, 0.0) for s in shares]
    total = float(tokens.sum())
    for _ in range(rounds):
        most = 0.0
        for m, (code, share) in enumerate(zip(codes, shares)):
            weight = tokens.astype(float)
            for f, c in zip(factors, codes):
                weight = weight * f[c]
            sums = np.bincount(code, weight, len(share))
            some = (sums > 0) & (share > 0)
            step = np.where(some, share * total / np.where(sums > 0, sums, 1.0), np.where(share > 0, 1.0, 0.0))
            most = max(most, float(np.abs(step[some] - 1).max(initial=0.0)))
            factors[m] = factors[m] * step
        if most < close:
            break
    return factors


def _driver_weights(spark: SparkSession, cells: DataFrame, margins: tuple[str, ...], targets: dict, power: float) -> DataFrame:
    rows = sorted(cells.collect(), key=lambda r: str(r[: len(margins)]))  # at most DRIVER_CELLS
    tokens = np.array([r[len(margins)] for r in rows], np.int64)
    codes, shares = [], []
    for m, name in enumerate(margins):
        own = {c: i for i, c in enumerate(dict.fromkeys(r[m] for r in rows))}
        codes.append(np.array([own[r[m]] for r in rows], int))
        sums = np.bincount(codes[-1], tokens, len(own))
        shares.append(_shares(sums, list(own), targets.get(name), power))
    weight = np.ones(len(rows))
    for f, c in zip(rake(tokens, codes, shares), codes):
        weight *= f[c]
    schema = ", ".join(f"__{i} {cells.schema[i].dataType.simpleString()}" for i in range(len(margins))) + ", __tokens bigint, __weight double"
    return spark.createDataFrame([(*r, float(w)) for r, w in zip(rows, weight)], schema)


def _spread_weights(cells: DataFrame, margins: tuple[str, ...], targets: dict, power: float, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """Rake factors by distributed sums; every round is written to the shared folder."""
    spark = cells.sparkSession
    cells = _common.written(cells.toDF(*[f"__{i}" for i in range(len(margins))], "__tokens"), "cells")
    total = cells.agg(F.sum("__tokens")).head()[0] or 0
    factors = []
    for i, name in enumerate(margins):
        sums = cells.groupBy(f"__{i}").agg(F.sum("__tokens").alias("s"))
        if targets.get(name) is None:
            want = sums.select(f"__{i}", F.pow("s", F.lit(power)).alias("w"))
        else:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[name].items()], f"c {cells.schema[i].dataType.simpleString()}, w double")
            want = sums.join(given, sums[f"__{i}"].eqNullSafe(given.c), "left").select(f"__{i}", F.when(F.col("s") > 0, F.greatest(F.lit(0.0), F.coalesce("w", F.lit(0.0)))).otherwise(0.0).alias("w"))
        whole = want.agg(F.sum("w")).head()[0] or 1.0
        factors.append(_common.written(want.select(F.col(f"__{i}").alias(f"c{i}"), (F.col("w") / whole).alias(f"share{i}"), F.when(F.col("w") > 0, 1.0).otherwise(0.0).alias(f"f{i}")), "factors"))

    def weighted() -> DataFrame:
        out = cells
        for i, f in enumerate(factors):
            out = out.join(f, out[f"__{i}"].eqNullSafe(f[f"c{i}"]))
        product = F.lit(1.0)
        for i in range(len(margins)):
            product = product * F.col(f"f{i}")
        return out.withColumn("__weight", product)

    for _ in range(rounds):
        most = 0.0
        for i in range(len(margins)):
            sums = weighted().groupBy(f"c{i}", f"share{i}", f"f{i}").agg(F.sum(F.col("__tokens") * F.col("__weight")).alias("s"))
            step = F.when((F.col("s") > 0) & (F.col(f"share{i}") > 0), F.col(f"share{i}") * total / F.nullif(F.col("s"), F.lit(0.0))).otherwise(F.when(F.col(f"share{i}") > 0, 1.0).otherwise(0.0))
            factors[i] = _common.written(sums.select(f"c{i}", f"share{i}", (F.col(f"f{i}") * step).alias(f"f{i}"), F.abs(step - 1).alias("off"), "s"), "factors")
            most = max(most, factors[i].filter((F.col("s") > 0) & (F.col(f"share{i}") > 0)).agg(F.max("off")).head()[0] or 0.0)
            factors[i] = factors[i].drop("off", "s")
        if most < close:
            break
    return weighted().select(*[f"__{i}" for i in range(len(margins))], "__tokens", "__weight")


def _top(weights: DataFrame, most: float, budget: float | None) -> float:
    """Return the weight of probability 1: the largest, at most ``most``; with a budget that by which expected tokens are its share."""
    highest, lowest, total = weights.agg(F.max("__weight"), F.min(F.when(F.col("__weight") > 0, F.col("__weight"))), F.sum("__tokens")).head()
    if not highest:
        return 1.0
    if budget is None or not total:
        return min(highest, most)
    low, high = lowest * 1e-9, highest / max(budget, 1e-9)
    for _ in range(50):  # the expected share falls as the top rises
        top = (low * high) ** 0.5
        share = weights.agg(F.sum(F.col("__tokens") * F.least(F.lit(1.0), F.col("__weight") / top))).head()[0] / total
        low, high = (top, high) if share > budget else (low, top)
    return high


def mixed(docs: DataFrame, margins: tuple[str, ...] = MARGINS, tokens: str = "n_tokens", key: str = "doc_id", targets: dict | None = None, power: float = POWER, driver_cells: int = DRIVER_CELLS, most: float = MOST, budget: float | None = None) -> DataFrame:
    """Return ``docs`` with columns weight, probability and sampled, which replace others of those names.

    ``targets`` has, for a margin's name, shares by category; a margin without
    gets shares in proportion to its tokens to the ``power``.  ``most`` bounds
    the weights and ``budget`` is the share of all tokens that is wanted.
    """
    spark = docs.sparkSession
    cells = _common.written(docs.groupBy(*margins).agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("__tokens")), "cells")
    few = cells.count() <= driver_cells
    weights = _driver_weights(spark, cells, margins, targets or {}, power) if few else _common.written(_spread_weights(cells, margins, targets or {}, power), "weights")
    top = _top(weights, most, budget)
    weights = weights.drop("__tokens")
    on = None
    for i, name in enumerate(margins):
        same = F.col(name).eqNullSafe(F.col(f"__{i}"))
        on = same if on is None else on & same
    kept = [c for c in docs.columns if c.lower() not in ("weight", "probability", "sampled")]
    joined = docs.join(F.broadcast(weights) if few else weights, on)
    chance = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(SEED)), 11).cast("double") / float(1 << 53)
    probability = F.round(F.least(F.lit(1.0), F.col("__weight") / top), 6)  # so that no way of summing decides
    return joined.select(*kept, F.col("__weight").alias("weight"), probability.alias("probability"), (chance < probability).alias("sampled"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its topic, tokens, weight, probability and whether it is sampled."""
    return mixed(marked(_common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")))


def sample(docs: DataFrame) -> DataFrame:
    """Return the sampled rows of ``docs``, with its columns; rows that have the same id, source, language and text stay or go together.

    What decides is worked out once, from a written table of ids and cells; the
    weights, not the texts, are joined.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # by place, as a column may bear any name of the result
    source, lang, key, text = (f"c{names.index(c)}" for c in ("source", "lang", "doc_id", "text"))
    mark = F.xxhash64(F.col(source).isNull(), source, lang, F.col(text).isNull(), text)
    made = marked(plain.select(source, lang, key, mark.alias("__mark"), text), "__topic", "__n", text)
    found = mixed(made, (source, lang, "__topic"), "__n", key).filter("sampled").select(F.col(key).alias("__id"), "__mark").distinct()
    found = _common.small(_common.written(found, "sampled"))
    on = F.col(key).eqNullSafe(F.col("__id")) & (mark == F.col("__mark"))
    return plain.join(found, on, "left_semi").select(*plain.columns).toDF(*names)
