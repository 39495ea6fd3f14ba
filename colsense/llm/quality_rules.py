"""Line-first cleaning: drop the lines that fail a rule, then reject documents that lose too much.

A document first gets whole-text counts (words, symbols, repeated lines and
repeated 8-word windows) with hard limits on them.  Then each line that has a
word is held against the line rules below; failing lines are removed.  A
document is kept if it passes the hard limits and the removed lines hold at
most ``MAX_LOST_PERCENT`` of its word characters.

Words are runs of anything but ASCII white space.  Line rules:

* punctuation: the line has more marks (``MARKS``) than words, or at least
  ``LONG_LINE`` words and none of ``STOPS``;
* navigation: at least three separators (``SEPARATORS``), at least one for
  every three words; or at least three words that are addresses (``LINKS``),
  at least one for every three words;
* boilerplate: it equals an earlier line of the text; or it has at most 30
  words and one of ``PHRASES`` (ASCII case ignored); or it is filler, more than
  half of its words being equal to the word before.

Defined results: a null or empty text, or one of white space only, has no
words, fails the hard limits and isn't kept; a line without a word is neither
judged nor removed; repeated rows are judged alike; columns of the input other
than the text are kept, except that the columns added replace those of the
same name (any case).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from colsense.llm import _common

SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&<>!=~^{}"
SEPARATORS = "|»›•·"
STOPS = ".!?…。！？"
LINKS = ("http://", "https://", "www.")
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "use of cookies",
    "enable javascript", "lorem ipsum", "our newsletter", "skip to content", "back to top", "powered by", "click here", "share this", "read more",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "zum seitenanfang", "jetzt weiterlesen",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions générales", "lire la suite",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "seguir leyendo",
)
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT, PHRASE_WORDS, LONG_LINE = 20, 8, 30, 30, 30, 40

ADDED = (("n_words", LongType()), ("word_chars", LongType()), ("n_symbols", LongType()), ("n_dup_lines", LongType()), ("n_repeat_words", LongType()), ("n_lines_removed", LongType()), ("lost_chars", LongType()), ("base_failed", BooleanType()), ("kept", BooleanType()), ("cleaned", StringType()))

_SPACES = " \t\n\v\f\r"
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)))
_LINKS = tuple(x.encode() for x in LINKS)
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Count the words that lie in a window of ``window`` words found twice or more, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    keys = np.zeros(n, np.uint64)
    for k in range(window):  # wraps around; equal keys are compared word by word below
        keys = keys * _ODD + ids[k : k + n] + np.uint64(1)
        keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    near = np.zeros(n, bool)
    near[1:] |= same
    near[:-1] |= same
    found: dict[bytes, list[int]] = {}
    for i in order[near].tolist():
        found.setdefault(ids[i : i + window].tobytes(), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for places in found.values():
        if len(places) > 1:
            at = np.array(places)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, _SPACES))


def line_fails(line: str, words: list[bytes]) -> bool:
    n_words = len(words)
    if sum(map(line.count, MARKS)) > n_words or n_words >= LONG_LINE and not any(map(line.count, STOPS)):
        return True
    separators = sum(map(line.count, SEPARATORS))
    if separators >= 3 and 3 * separators >= n_words:
        return True
    if 2 * sum(map(eq, words, words[1:])) > n_words:
        return True
    if 3 * line.count(".") >= n_words and n_words >= 3:  # every address has a full stop
        links = sum(w.lower().startswith(_LINKS) for w in words)
        if links >= 3 and 3 * links >= n_words:
            return True
    return n_words <= PHRASE_WORDS and _PHRASE.search(line.translate(_LOWER)) is not None


def judge(text: str | None) -> tuple:
    """Return the values of ``ADDED`` for one text."""
    text = text or ""
    words = text.encode().split()
    n_words, chars = len(words), word_chars(text)
    n_symbols = sum(map(text.count, SYMBOLS))
    n_repeat = repeated_words(words)
    seen: set[str] = set()
    good: list[str] = []
    n_dup = removed = lost = 0
    for line in text.split("\n"):
        own = line.encode().split()
        if own:
            again = line in seen
            seen.add(line)
            n_dup += again
            if again or line_fails(line, own):
                removed += 1
                lost += word_chars(line)
                continue
        good.append(line)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    kept = not base_failed and 100 * lost <= MAX_LOST_PERCENT * chars
    return n_words, chars, n_symbols, n_dup, n_repeat, removed, lost, base_failed, kept, "\n".join(good)


def cleaned(text: str | None) -> str:
    """Return ``text`` without its failing lines."""
    return judge(text)[-1]


def learned(text: str | None, quality: int) -> str | None:
    """Return what a classifier of cleaned texts learns from: good texts cleaned, bad ones as they are, for what the rules leave of them is mostly clean."""
    return cleaned(text) if quality else text


def evaluate(df: DataFrame, text: str = "text", columns: Iterable[str] | None = None) -> DataFrame:
    """Add the columns of ``ADDED`` (or those named) to ``df``; ``cleaned`` is the text without failing lines."""
    wanted = [(i, n, t) for i, (n, t) in enumerate(ADDED) if columns is None or n in set(columns)]
    names = {n for _, n, _ in wanted}
    at = df.columns.index(text)
    keep = [i for i, name in enumerate(df.columns) if name.lower() not in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain = plain.select(F.col(f"c{at}").alias("source"), *[F.col(f"c{i}").alias(f"k{i}") for i in keep])
    schema = StructType([f for f in plain.schema if f.name != "source"] + [StructField(n, t) for _, n, t in wanted])
    _common.bound_batches(df.sparkSession)
    kinds = {LongType(): pa.int64(), BooleanType(): pa.bool_(), StringType(): pa.string()}

    def run(batches):
        for batch in batches:
            rows = list(map(judge, batch.column(0).to_pylist()))
            arrays = [*batch.columns[1:], *[pa.array([r[i] for r in rows], kinds[t]) for i, _, t in wanted]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[1:], *[n for _, n, _ in wanted]])

    return plain.mapInArrow(run, schema).toDF(*[df.columns[i] for i in keep], *[n for _, n, _ in wanted])


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "lost_chars", "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``: its counts, whether the hard limits reject it, and whether it is kept."""
    docs = _common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return evaluate(docs, columns=RESULT).select("doc_id", *RESULT)


def filtered(docs: DataFrame) -> DataFrame:
    """Return the kept documents with failing lines removed; ``n_chars``, if there, follows the new text."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # by place, as a column may bear any name of the result
    text, size = f"c{names.index('text')}", f"c{names.index('n_chars')}" if "n_chars" in names else None
    judged = evaluate(plain.withColumn("source", F.col(text)), "source", ("kept", "cleaned")).filter("kept")
    judged = judged.withColumn(text, F.col("cleaned"))
    if size:
        judged = judged.withColumn(size, F.char_length("cleaned").cast(plain.schema[size].dataType))
    return judged.select(*plain.columns).toDF(*names)


_W = r"[^\x20\x09-\x0D]+"


def _class(chars: str) -> str:
    return "[" + re.sub(r"([\^\]\\-])", r"\\\1", chars) + "]"


_STARTS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else re.escape(c) for c in x) for x in LINKS)
_LEADS = ", ".join(f"lead(word, {k}) OVER o" for k in range(1, WINDOW))

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_W}') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM w WHERE len(ws) >= {WINDOW}),
u AS (SELECT r, i, g FROM (SELECT r, i, n, concat_ws(' ', word, {_LEADS}) AS g FROM p WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE i <= n - {WINDOW - 1}),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM u) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY r),
l AS (SELECT r, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM (SELECT r, string_split(t, chr(10)) AS ls FROM d)),
m AS (SELECT r, line, regexp_extract_all(line, '{_W}') AS ws, len(ws) AS n, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS dup,
             len(regexp_extract_all(line, '{_class(MARKS)}')) AS marks, len(regexp_extract_all(line, '{_class(SEPARATORS)}')) AS seps,
             length(array_to_string(ws, '')) AS chars, len(list_filter(list_zip(ws, ws[2:]), lambda x: x[1] = x[2])) AS same,
             len(list_filter(ws, lambda x: regexp_matches(x, '^({_STARTS})'))) AS links FROM l),
j AS (SELECT r, dup, chars, (dup OR marks > n OR (seps >= 3 AND 3 * seps >= n) OR 2 * same > n
             OR (n >= {LONG_LINE} AND NOT regexp_matches(line, '{_class(STOPS)}')) OR (links >= 3 AND 3 * links >= n)
             OR (n <= {PHRASE_WORDS} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(PHRASES)}'))) AS bad FROM m WHERE n > 0),
s AS (SELECT r, count(*) FILTER (WHERE dup) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_lines_removed, coalesce(sum(chars) FILTER (WHERE bad), 0)::BIGINT AS lost_chars FROM j GROUP BY r),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '{_class(SYMBOLS)}'))::BIGINT AS n_symbols, coalesce(s.n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(s.n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(s.lost_chars, 0)::BIGINT AS lost_chars
      FROM w LEFT JOIN s USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept FROM b
"""
