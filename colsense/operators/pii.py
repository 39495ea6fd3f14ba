"""Personal data in values and columns: spans, frequencies, ratios and dictionary hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.functions.pii import all_spans, without_overlaps
from colsense.functions.text import trimmed

#: A dictionary of at most so many rows may be broadcast.
BROADCAST_TERMS = 200_000


def with_spans(df: DataFrame, value: str = "value", name: str = "spans", any_case: bool = False) -> DataFrame:
    """Add the spans of column ``value``; the raw spans are materialised once, then freed of overlaps."""
    text = F.lower(trimmed(F.col(value))) if any_case else F.col(value)
    # An expression that isn't deterministic is neither copied nor pushed, so every text is searched once.
    raw = F.when(F.monotonically_increasing_id() >= 0, all_spans(text, any_case))
    return df.withColumn("__raw", raw).withColumn(name, without_overlaps(F.col("__raw"))).drop("__raw")


def span_types(spans: Column) -> Column:
    """Return the distinct kinds of a list of spans, sorted."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["type"])))


def primary_type(spans: Column) -> Column:
    """Return the most frequent kind of a list of spans, the first by name of equals; null if there is none."""
    kinds = span_types(spans)
    counted = F.transform(kinds, lambda k: F.struct((-F.size(F.filter(spans, lambda s: s["type"] == k))).alias("n"), k.alias("k")))
    return F.when(F.size(kinds) > 0, F.array_min(counted)["k"])


def frequencies(values: DataFrame, any_case: bool = False, by: tuple[str, ...] = ("column_name",), dictionary: DataFrame | None = None) -> DataFrame:
    """Return (by..., type, n_spans) of ``values`` (by..., value, n), each distinct value scanned once.

    With a ``dictionary`` (type, term) its kinds are counted as well, see ``dictionary_hits``.
    """
    spans = with_spans(values, any_case=any_case).select(*by, "n", F.explode("spans").alias("s"))
    found = spans.groupBy(*by, F.col("s.type").alias("type")).agg(F.sum("n").cast("bigint").alias("n_spans"))
    return found if dictionary is None else found.unionByName(dictionary_hits(values, dictionary, by=by))


def ratios(values: DataFrame, by: tuple[str, ...] = ("column_name",), dictionary: DataFrame | None = None) -> DataFrame:
    """Return (by..., type, n_spans, ratio); values are trimmed and lower-cased, null and blank ones count in the ratio.

    A column without personal data has one row of null type.
    """
    sizes = values.groupBy(*by).agg(F.sum("n").alias("size"))
    found = frequencies(values, any_case=True, by=by, dictionary=dictionary)
    return sizes.join(found, list(by), "left").select(*by, "type", F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.when(F.col("size") > 0, F.coalesce("n_spans", F.lit(0)) / F.col("size")).otherwise(0.0).alias("ratio"))


def dictionary_hits(values: DataFrame, dictionary: DataFrame, most_words: int = 3, by: tuple[str, ...] = ("column_name",)) -> DataFrame:
    """Return (by..., type, n_spans): the n-grams of words of ``values`` that ``dictionary`` (type, term) holds, in any case.

    The dictionary is broadcast if it has at most ``BROADCAST_TERMS`` rows; a
    longer one is joined by shuffle.
    """
    words = F.regexp_extract_all(F.lower("value"), F.lit("[a-z]+(?:['-][a-z]+)*"), F.lit(0))
    tokens = values.select(*by, "n", words.alias("words"))

    def grams(k: int) -> Column:
        starts = F.when(F.size("words") >= k, F.sequence(F.lit(1), F.size("words") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(k)), " "))

    terms = tokens.select(*by, "n", F.explode(F.concat(*[grams(k) for k in range(1, most_words + 1)])).alias("term")).groupBy(*by, "term").agg(F.sum("n").alias("n"))
    known = dictionary.select("type", F.lower("term").alias("term")).distinct()
    if dictionary.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    return terms.join(known, "term").groupBy(*by, "type").agg(F.sum("n").cast("bigint").alias("n_spans"))
