"""Document quality from a linear-chain conditional random field over lines.

Every line with a word gets a feature vector: its own measures and those of
the lines before and after.  A chain with the labels good and bad is fitted to
labelled documents whose lines' labels are latent: every line of a good
document is good, and a bad document has a bad line, no matter which.  The
likelihood sums over the label sequences that agree with this, so the chain
also learns where lines of a bad document change.  At scoring, forward-backward
gives each line's probability of being good.  Their mean, weighted by line
length, goes through a fitted logistic map and is the document's score.

Fitting uses at most ``SAMPLE`` labelled documents, those of the smallest hash
of their id, and as many different rows, of at most ``SAMPLE_LINES`` lines
each; their features (not their texts) come to the driver.  Scoring covers
whole texts of all rows.

Defined results: a text without words (null too) counts as one line without
any measure; without labelled documents of both kinds every score is the share
of good ones (0.5 if there are none); a null id is never held out; rows of one
id with different labels count as bad; repeated rows score alike; further
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.llm import _common

SAMPLE, SAMPLE_LINES, ROUNDS, RIDGE, BAD_WEIGHT, THRESHOLD = 4000, 150, 700, 0.01, 4.0, 0.3
#: Lines whose measures are held at once, and from which on the texts read so far are scored.
HELD_LINES, SCORED_LINES = 1 << 14, 1 << 19
MARKS, SEPARATORS, STOPS = "#*$%&<>=~^{}@\\_", "|»›•·", ".,;:!?"
MEASURES = 13


def _measured(text: str | None) -> Iterator[tuple[list[float], int]]:
    """Yield the measures and the length of each line of ``text`` that has a word; without any, of one line without any measure."""
    seen = set()
    for line in (text or "").split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        chars = len(line)
        last = words[-1][-1]
        yield [
            min(2.0, sum(map(line.count, MARKS)) / n), min(1.0, sum(map(line.count, SEPARATORS)) / n), min(2.0, line.count("!") / n),
            sum(map(str.isupper, words)) / n, sum(map(eq, words, words[1:])) / n, len(set(words)) / n, sum(map(str.isdigit, words)) / n,
            1.0 if last in ".!?" else 0.0, min(1.0, sum(map(line.count, STOPS)) / n), min(2.0, chars / n / 10), min(1.0, np.log1p(n) / 6),
            1.0 if line in seen else 0.0, 1.0,
        ], chars
        seen.add(line)
    if not seen:
        yield [0.0] * MEASURES, 1


def measures(text: str | None) -> tuple[list[list[float]], list[int]]:
    """Return the measures and the length of each line of ``text`` that has a word."""
    rows, sizes = zip(*_measured(text))
    return list(rows), list(sizes)


def features(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Join each line's measures with those of its neighbours; beyond a document's ends they are zero."""
    ends = np.cumsum(counts)
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.concatenate([rows, before, after], axis=1)


@dataclass(frozen=True)
class Chain:
    """Weights of the features for the label good, of the step between labels, and of the map of the mean."""

    weight: np.ndarray
    step: np.ndarray  # [from, to], 0 bad, 1 good
    slope: float = 1.0
    offset: float = 0.0

    def all_good(self, made: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Return each document's log weight of the sequence without a bad line."""
        return np.add.reduceat(made @ self.weight, np.cumsum(counts) - counts) + (counts - 1) * self.step[1, 1]

    def _passes(self, weights: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Return each line's log weights of bad and good, from that of good, both passes' sums and each document's log partition."""
        unary = np.zeros((len(weights), 2))
        unary[:, 1] = weights
        order = np.argsort(-counts, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        long = counts[order]
        forward, backward = unary.copy(), np.zeros_like(unary)
        most = int(long[0]) if len(long) else 0
        live = [int(np.searchsorted(-long, -t, side="left")) for t in range(most + 1)]  # documents of more than t lines
        for t in range(1, most):
            at = starts[: live[t]] + t
            old = forward[at - 1]
            for to in (0, 1):
                forward[at, to] += np.logaddexp(old[:, 0] + self.step[0, to], old[:, 1] + self.step[1, to])
        for t in range(most - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            new = backward[at + 1] + unary[at + 1]
            for of in (0, 1):
                backward[at, of] = np.logaddexp(new[:, 0] + self.step[of, 0], new[:, 1] + self.step[of, 1])
        ends = np.cumsum(counts) - 1
        total = np.logaddexp(forward[ends, 0], forward[ends, 1]) if len(counts) else np.zeros(0)
        return unary, forward, backward, total

    @staticmethod
    def _good(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        joint = forward + backward
        return 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -700, 700)))

    def marginals(self, made: np.ndarray, counts: np.ndarray, steps_of: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Return each line's probability of good, expected steps summed over all, and each document's log partition.

        ``steps_of`` gives, from the log partitions, a weight for each document's steps.
        """
        unary, forward, backward, total = self._passes(made @ self.weight, counts)
        good = self._good(forward, backward)
        ends = np.cumsum(counts) - 1
        steps = np.zeros((2, 2))
        inner = np.ones(len(made), bool)
        inner[ends] = False
        at = np.flatnonzero(inner)
        each = np.repeat(total, counts)[at]
        weight = np.repeat(steps_of(total), counts)[at] if steps_of else np.ones(len(at))
        for of in (0, 1):
            for to in (0, 1):
                steps[of, to] = weight @ np.exp(forward[at, of] + self.step[of, to] + unary[at + 1, to] + backward[at + 1, to] - each)
        return good, steps, total

    def mean(self, made: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Return each document's mean probability of good, weighted by line length."""
        return self._mean(made @ self.weight, counts, sizes) if len(counts) else np.zeros(0)

    def _mean(self, weights: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        _, forward, backward, _ = self._passes(weights, counts)
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(self._good(forward, backward) * sizes, starts) / np.add.reduceat(sizes.astype(float), starts)

    def _weighed(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Return the log weight of good and the length of each line of ``text``; measures are held for ``HELD_LINES`` lines at most."""
        lines, parts, sizes = _measured(text), [], []
        while held := list(itertools.islice(lines, HELD_LINES)):
            parts.append(np.array([r for r, _ in held]) @ self.weight.reshape(3, MEASURES).T)
            sizes.append(np.array([n for _, n in held]))
        own, before, after = np.concatenate(parts).T
        weights = own.copy()
        weights[1:] += before[:-1]
        weights[:-1] += after[1:]
        return weights, np.concatenate(sizes)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Return the score of each text; memory follows ``SCORED_LINES`` and the longest text, not the lines of all."""
        means, held, lines = [np.zeros(0)], [], 0
        for k, text in enumerate(texts):
            held.append(self._weighed(text))
            lines += len(held[-1][1])
            if lines >= SCORED_LINES or k + 1 == len(texts):
                counts = np.array([len(n) for _, n in held])
                means.append(self._mean(np.concatenate([w for w, _ in held]), counts, np.concatenate([n for _, n in held])))
                held, lines = [], 0
        return _logistic(self.slope * _logit(np.concatenate(means)) + self.offset)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def fit(rows: np.ndarray, counts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, ridge: float = RIDGE) -> Chain:
    """Fit a chain to documents of ``counts`` lines and the map of its mean to ``labels`` (0 or 1)."""
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
        return Chain(np.zeros(3 * MEASURES), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    made = features(rows, counts)
    flat, first, second = np.zeros(3 * MEASURES + 4), 0.0, 0.0
    for k in range(1, rounds + 1):  # Adam on the log likelihood
        chain = Chain(flat[:-4], flat[-4:].reshape(2, 2))
        best = chain.all_good(made, counts)

        def pull(total: np.ndarray) -> np.ndarray:
            """Return how strongly each document wants the sequence without a bad line: 1 if good, else -q / (1 - q), times ``BAD_WEIGHT``."""
            return np.where(labels == 1, 1.0, -BAD_WEIGHT / np.expm1(np.clip(total - best, 1e-6, 700)))

        good, steps, total = chain.marginals(made, counts, pull)
        weight = pull(total)
        steps[1, 1] -= weight @ (counts - 1)
        slope = np.concatenate([made.T @ (np.repeat(weight, counts) * (good - 1)), steps.ravel()]) / len(labels) + ridge * flat / len(labels)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        flat = flat - 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    chain = Chain(flat[:-4], flat[-4:].reshape(2, 2))
    x = np.stack([_logit(chain.mean(made, counts, sizes)), np.ones(len(labels))], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(25):  # Newton, with a pull towards the mean itself
        p = _logistic(x @ line)
        slope = x.T @ (p - labels) + (line - [1.0, 0.0])
        line = line - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), slope)
    return Chain(chain.weight, chain.step, float(max(line[0], 1e-3)), float(line[1]))


def held_out(key: Column) -> Column:
    """Tell whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, view: Callable[[str | None, int], str | None] | None = None) -> Chain:
    """Fit a chain to ``docs`` (doc_id, text) with ``labels`` (doc_id, quality), without the held-out ids.

    ``view`` makes of a text and its label what is learned from.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so many rows at most: may be broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("key"), "quality", "text")
    # An id may stand in any number of rows, so the rows are bounded as well; equal rows count once.
    few = joined.select("key").distinct().orderBy("key").limit(sample)

    def make(batch: pa.RecordBatch) -> dict:
        found = [measures(x if view is None else view(x, q)) for q, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        found = [(r, s) if len(r) <= SAMPLE_LINES else ([], []) for r, s in found]
        return {"key": batch.column(0), "quality": batch.column(1), "rows": [np.array(r, np.float32).tobytes() for r, _ in found], "sizes": [np.array(s, np.int64).tobytes() for _, s in found]}

    made = _common.map_batches(joined.join(F.broadcast(few), "key"), make, "key bigint, quality int, rows binary, sizes binary")
    got = made.groupBy("key").agg(*[F.first(c).alias(c) for c in ("quality", "rows", "sizes")]).collect()
    got = sorted((r for r in got if r.sizes), key=lambda r: r.key)  # the order of tasks doesn't matter
    sizes = [np.frombuffer(r.sizes, np.int64) for r in got]
    rows = np.frombuffer(b"".join(bytes(r.rows) for r in got), np.float32).astype(float).reshape(-1, MEASURES)
    return fit(rows, np.array([len(x) for x in sizes], int), np.concatenate(sizes or [np.zeros(0, int)]), np.array([r.quality for r in got]))


def score(docs: DataFrame, chain: Chain, text: str = "text", name: str = "score") -> DataFrame:
    """Return ``docs`` with column ``name`` (double), which replaces one of that name."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]

    @F.pandas_udf("double")
    def scored(x):
        import pandas as pd

        return pd.Series(chain.scores([None if v is None or v is pd.NA or v != v else v for v in x]))

    _common.bound_batches(docs.sparkSession)
    return docs.withColumn("__score", scored(F.col(text))).select(*kept, F.col("__score").alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its score, by a chain fitted to ``labels`` that aren't held out."""
    docs = _common.table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, _common.table(spark, sf_dir, "labels"))
    scored = score(docs, chain)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """Return the rows of ``docs`` whose text scores at least ``threshold``."""
    return score(docs, chain, name="__accepted").filter(F.col("__accepted") >= threshold).select(*docs.columns)
