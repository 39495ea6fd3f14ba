"""Ten statistical features of a value and the score that tells digests and addresses from words.

Features are rounded to nine decimals before they meet a threshold, so that the
order of a sum can't flip it.  All lists are linear in the value's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.functions import vocab
from colsense.functions.predicates import crypto_types
from colsense.functions.text import trimmed, whole

FEATURES = ("entropy", "chi_square", "bigram_entropy", "uniformity", "serial_correlation", "runs_z", "vowel_ratio", "digit_ratio", "case_mix", "run_length_ratio")
BASE58 = "[1-9A-HJ-NP-Za-km-z]+"
HASH_SCORE, STRICT_CONFIDENCE = 25, 0.75


def _total(values: Column, each) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + each(x))


def _run_lengths(ordered: Column) -> Column:
    """Return the lengths of runs of equal neighbours, as a sum of n * log2(n): one pass over a sorted list."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        again = x == s["last"]
        done = s["sum"] + F.when(s["n"] > 1, s["n"] * F.log2(s["n"].cast("double"))).otherwise(0.0)
        return F.struct(x.alias("last"), F.when(again, s["n"] + 1).otherwise(1).alias("n"), F.when(again, s["sum"]).otherwise(done).alias("sum"))

    return F.aggregate(ordered, zero, step, lambda s: s["sum"] + F.when(s["n"] > 1, s["n"] * F.log2(s["n"].cast("double"))).otherwise(0.0))


def with_hash_features(df: DataFrame, value: str = "value") -> DataFrame:
    """Add the features of column ``value``; a null or blank value has null features."""
    clean = trimmed(F.col(value))
    df = df.withColumn("__t", F.when(clean != "", clean)).withColumn("__len", F.char_length("__t")).withColumn("__chars", F.split("__t", ""))
    df = df.withColumn("__counts", F.transform(F.array_distinct("__chars"), lambda c: (F.col("__len") - F.char_length(F.replace(F.col("__t"), c, F.lit("")))).cast("double")))
    df = df.withColumn("__codes", F.transform("__chars", lambda c: F.ascii(c).cast("double"))).withColumn("__kinds", F.size("__counts"))
    df = df.withColumn("__mean", _total(F.col("__codes"), lambda x: x) / F.col("__len"))
    n = F.col("__len").cast("double")
    pairs = lambda name, f: F.zip_with(F.slice(name, F.lit(1), F.col("__len") - 1), F.slice(name, F.lit(2), F.col("__len") - 1), f)
    longer = F.col("__len") >= 2
    counts, mean = F.col("__counts"), F.col("__mean")
    expected = n / F.col("__kinds")
    spread = F.sqrt(_total(counts, lambda x: (x - expected) * (x - expected)) / F.col("__kinds"))
    bigrams = F.array_sort(pairs("__chars", lambda a, b: F.concat(a, b)))
    moved = _total(pairs("__codes", lambda a, b: (a - mean) * (b - mean)), lambda x: x)
    base = _total(F.slice("__codes", F.lit(1), F.col("__len") - 1), lambda x: (x - mean) * (x - mean))
    above = _total(F.col("__codes"), lambda x: F.when(x > mean, 1.0).otherwise(0.0))
    runs = 1 + _total(pairs("__codes", lambda a, b: F.when((a > mean) != (b > mean), 1.0).otherwise(0.0)), lambda x: x)
    df = df.withColumn("__above", above).withColumn("__runs", F.when(longer, runs))
    n1, n2 = F.col("__above"), n - F.col("__above")
    product = 2 * n1 * n2
    variance = product * (product - n) / (n * n * F.nullif(n - 1, F.lit(0.0)))
    low = F.lower("__t")
    letters = F.regexp_count(low, F.lit(r"\p{javaLetter}"))
    upper = F.transform("__chars", lambda c: c.rlike(r"\A\p{javaUpperCase}"))
    df = df.withColumn("__upper", upper)
    made = {
        "entropy": _total(counts, lambda x: -(x / n) * F.log2(x / n)),
        "chi_square": _total(counts, lambda x: (x - expected) * (x - expected) / expected),
        "bigram_entropy": F.when(longer, F.log2(n - 1) - _run_lengths(bigrams) / (n - 1)).otherwise(0.0),
        "uniformity": 1 / (1 + spread / expected),
        "serial_correlation": F.when(longer & (base > 0), moved / F.nullif(base, F.lit(0.0))).otherwise(0.0),
        "runs_z": F.when(longer & (variance > 0), (F.col("__runs") - (product / n + 1)) / F.sqrt(variance)).otherwise(0.0),
        "vowel_ratio": F.when(letters > 0, F.regexp_count(low, F.lit("[aeiou]")) / F.nullif(letters, F.lit(0))).otherwise(0.0),
        "digit_ratio": F.regexp_count("__t", F.lit(r"\p{javaDigit}")) / n,
        "case_mix": F.when(longer, _total(pairs("__upper", lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), lambda x: x) / F.greatest(F.lit(1.0), n - 1)).otherwise(0.0),
        "run_length_ratio": F.char_length(F.regexp_replace("__t", r"(?s)(.)\1+", "xx")) / n,
    }
    df = df.withColumns({name: F.when(F.col("__len") > 0, F.round(c, 9)) for name, c in made.items()})
    return df.drop("__chars", "__counts", "__codes", "__kinds", "__mean", "__above", "__runs", "__upper")


def with_hash_score(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``score``, ``is_hash``, ``confidence`` (0 to 1) and ``hash_types`` of column ``value``."""
    df = with_hash_features(df, value)
    t, n, spaced = F.col("__t"), F.col("__len"), F.col("__t").contains(" ")
    hexed, prefixed = whole(t, "[a-fA-F0-9]+"), whole(t, "0x[a-fA-F0-9]+")
    base58, bech32 = whole(t, BASE58), whole(t, "(bc1|tb1)[a-z0-9]+")
    f = {name: F.col(name) for name in FEATURES}
    rules = [
        F.when(f["entropy"] > 3.5, 15).when(f["entropy"] < 2.5, -10),
        F.when((f["chi_square"] < 50) & ~spaced, 12),
        F.when(f["bigram_entropy"] > 4.5, 13).when(f["bigram_entropy"] < 3.0, -8),
        F.when((f["uniformity"] > 0.85) & (n > 20), 10),
        F.when((F.abs(f["serial_correlation"]) < 0.1) & (n > 20), 10),
        F.when((F.abs(f["runs_z"]) < 2.0) & (n > 20), 8),
        F.when((f["vowel_ratio"] > 0) & (f["vowel_ratio"] < 0.3) & ~spaced, 8).when((f["vowel_ratio"] > 0.35) & (f["vowel_ratio"] < 0.45), -12),
        F.when((f["digit_ratio"] > 0.3) & ~spaced, 10),
        F.when((f["case_mix"] > 0.8) & ~spaced & (n > 20), 7),
        F.when((f["run_length_ratio"] > 0.9) & (n > 30), 10),
        F.when(hexed | prefixed, 20),
        F.when(prefixed, 15),
        F.when(base58 & n.between(26, 35), 18),
        F.when(bech32, 25),
        F.when(n.isin(*vocab.HASH_LENGTHS) & (hexed | prefixed), 15),
        F.when(spaced, -30),
        F.when((n < 10) & whole(t, "[a-zA-Z]+"), -20),
        F.when(prefixed & (n == 66), 20),
        F.when(prefixed & (n == 42), 20),
        F.when(t.rlike(r"\A(?:1|3|bc1)") & (base58 | bech32), 15),
    ]
    score = F.lit(0)
    for r in rules:
        score = score + F.coalesce(r, F.lit(0))
    df = df.withColumn("score", F.when(t.isNotNull(), score.cast("double")).otherwise(0.0))
    df = df.withColumn("is_hash", t.isNotNull() & (F.col("score") >= HASH_SCORE))
    df = df.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") * 1.2)) / 100)
    types = F.when(t.isNotNull(), crypto_types(F.col(value))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("hash_types", types).drop("__t", "__len")
