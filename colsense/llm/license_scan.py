"""Licence scan: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts become sequences of lower-case words.

1. Templates of over ``SHORT`` words: of every ``GRAM`` words in a row a hash is
   taken; of every ``WINDOW`` hashes in a row the smallest is a fingerprint, so
   a run of ``GRAM + WINDOW - 1`` equal words always shares one.  An inverted
   index gives, for a text's fingerprints, the templates and diagonals where
   they stand; a diagonal's neighbourhood with at least ``HITS`` of a template's
   fingerprints is a candidate.
2. Shorter templates are lines that name a licence.  Each has deciding words
   (its name, version and conditions) that a match must have, so the one that
   the fewest templates have is its fingerprint: wherever it stands is a
   candidate, and no match is missed.  Exact copies need no alignment.
3. A local alignment within a band around the candidate's diagonal counts the
   template's words that stand in the text in order.  A match covers at least
   ``COVERAGE`` of the template, has all its deciding words, and holds none of
   ``RIVALS`` (such as "Lesser" or "NC") that the template doesn't.  What lies
   outside a match is aligned again.  Of matches that overlap the better stays.

The index and the templates have a fixed size and go with the tasks; texts
never move.

Defined results: a null or empty text has no matches (an empty list); words are
runs of letters, digits and underscores; a text may hold a template many times;
of equally good matches the template's order decides; repeated rows are scanned
alike; columns of the input are kept by ``scan``, except those of its result's
names (any case).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.llm import _common
from colsense.llm.license_texts import RIVALS, templates

GRAM, WINDOW, COVERAGE, BAND, SHORT, HITS = 3, 3, 0.8, 8, 30, 1 / 8
_WORD = re.compile(r"\w+")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return (places, hashes) of the winnowed grams of ``words`` (numbers; 0 is a word of no template)."""
    n = len(words) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(GRAM):
        part = words[k : k + n]
        grams = _mix(grams + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        known &= part > 0
    grams[~known] = _NONE  # matches nothing, so it may lose every window
    width = min(WINDOW, n)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    picked = np.unique(np.arange(len(views)) + views.shape[1] - 1 - views[:, ::-1].argmin(axis=1))
    picked = picked[grams[picked] != _NONE]
    return picked, grams[picked]


class Index:
    """Templates as word numbers, the inverted index of their fingerprints, and the anchors of the short ones."""

    def __init__(self, rows: tuple[tuple[str, str, str, str], ...]):
        self.templates = rows
        self.numbers: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.deciding: list[frozenset[int]] = []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for _, _, text, deciding in rows:
            found = _WORD.findall(text.lower())
            self.words.append(np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in found], np.int64))
            self.deciding.append(frozenset(self.numbers[w] for w in deciding.split()))
        self.rivals = frozenset(self.numbers.setdefault(w, len(self.numbers) + 1) for w in RIVALS)
        holders = np.zeros(len(self.numbers) + 1, int)
        for own in self.words:
            holders[np.unique(own)] += 1
        self.grams = np.zeros(len(rows), int)
        self.short: list[tuple[int, int, list[int]]] = []  # template, anchor word, its places in the template; longer ones first
        for t, own in enumerate(self.words):
            if len(own) <= SHORT and self.deciding[t]:
                anchor = min(sorted(self.deciding[t]), key=lambda w: holders[w])
                self.short.append((t, anchor, np.flatnonzero(own == anchor).tolist()))
            else:
                found = fingerprints(own)
                self.grams[t] = len(found[0])
                for at, gram in zip(*(x.tolist() for x in found)):
                    self.places[gram].append((t, at))
        self.short.sort(key=lambda x: (-len(self.words[x[0]]), x[0]))
        self.maybe = np.zeros(1 << 20, bool)  # by the low bits of a gram
        self.maybe[np.array([g & 0xFFFFF for g in self.places], np.int64)] = True
        self.counts = [np.unique(own, return_counts=True) for own in self.words]

    def crowded(self, words: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
        """Return (template, hits (diagonal, place in the text)) of neighbourhoods with enough of a long template's fingerprints."""
        places, grams = fingerprints(words)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in np.flatnonzero(self.maybe[(grams & np.uint64(0xFFFFF)).astype(np.int64)]).tolist():
            if int(grams[i]) not in self.places:
                continue
            for t, at in self.places[int(grams[i])]:
                hits[t].append((int(places[i]) - at, int(places[i])))
        out = []
        for t, own in hits.items():
            if len(own) < HITS * self.grams[t]:
                continue
            band, groups = _band(len(self.words[t])), []
            for hit in sorted(own):
                if not groups or hit[0] - groups[-1][0][0] > band:
                    groups.append([])
                groups[-1].append(hit)
            diagonals = sorted(own)
            for group in groups:
                near = diagonals[bisect_left(diagonals, (group[0][0] - band, -1)) : bisect_left(diagonals, (group[-1][0] + band + 1, -1))]
                if len({place - d for d, place in near}) >= HITS * self.grams[t]:
                    out.append((t, group))
        return out


def _band(size: int) -> int:
    return max(BAND, size // 8)


def align(template: np.ndarray, words: np.ndarray, offset: int, band: int) -> tuple[list[int], list[int], int, int]:
    """Return (matched template places, their places in ``words``, start, end) of the best local alignment near diagonal ``offset``.

    A matched word counts 2, any other step -1.  Cell (i, k) pairs template word
    i with text word i + offset - band + k.
    """
    width, n, size = 2 * band + 1, len(words), len(template)
    low = offset - band
    padded = np.full(size + width, -1, np.int64)
    first, last = max(0, low), min(n, low + size + width)
    if first < last:
        padded[first - low : last - low] = words[first:last]
    cells = np.zeros((size + 1, width + 1), np.int32)  # one more column, so that a skipped template word has a cell to come from
    slope = np.arange(width, dtype=np.int32)
    for i in range(size):
        beside = padded[i : i + width]
        row = np.maximum(np.maximum(cells[i, :width] + np.where(beside == template[i], 2, -1), cells[i, 1:] - 1), 0)
        row[beside < 0] = 0
        cells[i + 1, :width] = np.maximum.accumulate(row + slope) - slope  # skipped text words
    at = int(cells[1:, :width].argmax())
    i, k = divmod(at, width)
    value = int(cells[i + 1, k])
    if not value:
        return [], [], 0, 0
    own, places, end = [], [], i + low + k + 1
    start = end
    while i >= 0 and k >= 0 and value > 0:
        same = padded[i + k] == template[i]
        if padded[i + k] >= 0 and cells[i, k] + (2 if same else -1) == value:
            start = i + low + k
            if same:
                own.append(i)
                places.append(start)
            i, value = i - 1, int(cells[i, k])
        elif cells[i, k + 1] - 1 == value:
            i, k, value = i - 1, k + 1, value + 1
        else:
            k, value = k - 1, value + 1
    return own[::-1], places[::-1], start, end


def _accepted(index: Index, t: int, words: np.ndarray, own: list[int], places: list[int], start: int, end: int) -> bool:
    template = index.words[t]
    if len(own) < COVERAGE * len(template):
        return False
    matched = set(places)
    if not index.deciding[t] <= set(template[own].tolist()):
        return False
    skipped = np.ones(len(template), bool)
    skipped[own] = False
    if index.deciding[t] and set(template[skipped].tolist()) & index.deciding[t] & set(template[own].tolist()) and len(template) <= SHORT:
        return False  # a deciding word that stands twice must match twice
    return not any(w in index.rivals and start + k not in matched for k, w in enumerate(words[start:end].tolist()))


def _copies(index: Index, t: int, words: np.ndarray, group: list[tuple[int, int]], gram: int) -> list[tuple]:
    """Return every match of template ``t`` around a group of hits (diagonal, place): what is outside a match is aligned again."""
    template = index.words[t]
    band, out, todo = _band(len(template)), [], [(0, len(words), group)]
    while todo:
        low, high, own = todo.pop()
        diagonal = own[len(own) // 2][0]
        low_at, high_at = max(low, diagonal - band), min(high, diagonal + len(template) + band)
        part = words[low_at:high_at]
        matched, places, start, end = align(template, part, diagonal - low_at, band)
        if not _accepted(index, t, part, matched, places, start, end):
            continue
        start, end = start + low_at, end + low_at
        out.append((-len(matched), -len(matched) / len(template), t, start, end))
        for a, b, rest in ((low, start, [h for h in own if h[1] + gram <= start]), (end, high, [h for h in own if h[1] >= end])):
            if rest:
                todo.append((a, b, rest))
    return out


def _lines(index: Index, words: np.ndarray) -> list[tuple]:
    """Return the matches of the short templates; a copy hides its words from templates that can't be better."""
    out, present = [], set(np.unique(words).tolist())
    some = [one for one in index.short if index.deciding[one[0]] <= present]
    if not some:
        return out
    cover = np.zeros(len(words), int)  # the length of the longest copy that holds a word
    for t, anchor, inside in some:
        template = index.words[t]
        n, last = len(template), -1
        fits = np.flatnonzero(words == anchor) - inside[0]
        fits = fits[(fits >= 0) & (fits + n <= len(words))]
        for k in range(n):
            fits = fits[words[fits + k] == template[k]]
        kept = []
        for start in fits.tolist():
            if start >= last:  # copies of a line can't overlap
                kept.append(start)
                last = start + n
        out += [(-n, -1.0, t, start, start + n) for start in kept]
        for k in range(n if kept else 0):
            at = np.array(kept) + k
            cover[at] = np.maximum(cover[at], n)
    for t, anchor, inside in some:
        n = len(index.words[t])
        own = np.where(cover >= n, 0, words)
        band, (kinds, counts) = _band(n), index.counts[t]
        found: set[tuple] = set()
        for place in np.flatnonzero(own == anchor).tolist():
            near = own[max(0, place - n - band) : place + n + band]
            if sum(min(int(c), int((near == w).sum())) for w, c in zip(kinds, counts)) >= COVERAGE * n:
                for i in inside:
                    found.update(_copies(index, t, own, [(place - i, place)], 1))
        out += found
    return out


def matches(index: Index, text: str | None) -> list[dict]:
    """Return the licence matches in ``text``, by place: licence, template, coverage and span of characters."""
    if not text:
        return []
    low = text.lower()
    numbers = np.array([index.numbers.get(w, 0) for w in _WORD.findall(low)], np.int64)
    found = _lines(index, numbers)
    for t, group in index.crowded(numbers):
        found += _copies(index, t, numbers, group, GRAM)
    if not found:
        return []
    starts, taken = [], []  # of the matches that stay, by place
    for one in sorted(found):
        at = bisect_left(starts, one[3])
        if (at == 0 or taken[at - 1][4] <= one[3]) and (at == len(taken) or one[4] <= starts[at]):
            starts.insert(at, one[3])
            taken.insert(at, one)
    # Lower case may change a text's length; then places are counted in words of the text itself.
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) != len(numbers):
        spans = [m.span() for m in _WORD.finditer(low)]
    out = []
    for score, _, t, start, end in taken:
        name, licence = index.templates[t][:2]
        out.append({"licence": licence, "template": name, "coverage": -score / len(index.words[t]), "start": spans[start][0], "end": spans[end - 1][1]})
    return out


@lru_cache(maxsize=4)
def index_of(rows: tuple | None = None) -> Index:
    return Index(rows or templates())


RESULT = "array<struct<licence:string,template:string,coverage:double,start:int,end:int>>"


def scan(docs: DataFrame, text: str = "text", rows: tuple | None = None, name: str = "matches") -> DataFrame:
    """Return ``docs`` with column ``name``: the matches of all templates (or of ``rows``) in column ``text``, by place."""

    @F.pandas_udf("licence array<string>, template array<string>, coverage array<double>, start array<int>, end array<int>")
    def found(x):
        import pandas as pd

        index = index_of(rows)
        made = [matches(index, v if isinstance(v, str) else None) for v in x]
        return pd.DataFrame({k: [[m[k] for m in own] for own in made] for k in ("licence", "template", "coverage", "start", "end")})

    _common.bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    return docs.withColumn("__matches", found(F.col(text))).select(*kept, F.arrays_zip(*[F.col(f"__matches.{k}").alias(k) for k in ("licence", "template", "coverage", "start", "end")]).cast(RESULT).alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its licences and the matches behind them."""
    scanned = scan(_common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    licences = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return scanned.select("doc_id", F.size("matches").alias("n_matches"), licences.alias("licences"), "matches")
