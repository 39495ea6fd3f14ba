"""Operators on columns in long form: profile, index confidence, votes, most frequent, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsense.functions.hashing import STRICT_CONFIDENCE, with_hash_score
from colsense.functions.predicates import is_gender, is_job_title
from colsense.functions.text import blank, trimmed, whole
from colsense.functions.types import value_forms

NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]*)?)(?:[eE][+-]?[0-9]+)?"


def number(value: Column) -> Column:
    """Return the number a text holds, thousands commas allowed; null if it holds none."""
    clean = trimmed(value)
    return F.when(whole(clean, NUMBER), F.replace(clean, F.lit(","), F.lit("")).try_cast("double"))


def ratio(part: Column, whole_: Column) -> Column:
    """Divide counts; 0 if there is nothing to divide by."""
    return F.when(whole_ > 0, part / whole_).otherwise(0.0)


def profile(long: DataFrame) -> DataFrame:
    """Return rows, missing rows, distinct values, and whether the column is an id: nothing missing, all unique."""
    return profile_of_values(long.groupBy("column_name", "value").agg(F.count("*").alias("n")))


def profile_of_values(values: DataFrame) -> DataFrame:
    """Return the profile from distinct values (column_name, value, n)."""
    made = values.groupBy("column_name").agg(F.sum("n").cast("bigint").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("n_missing"), F.count("value").alias("n_unique"))
    return made.withColumn("is_id", (F.col("n_missing") == 0) & (F.col("n_unique") == F.col("n_rows")))


def index_confidence(long: DataFrame, threshold: float = 0.7, chunks: int | None = None) -> DataFrame:
    """Return (column_name, n, confidence, is_index): how much each column looks like a row number.

    Missing values are left out; a value that is no number rules the column
    out (confidence 0).  Neighbours are compared in ranges of ``pos``, and at
    the borders of the ranges once more, so no column is sorted in one task.
    """
    values = long.filter(~blank(F.col("value"))).withColumn("v", number(F.col("value")))
    parts = chunks or max(2, int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = values.select("column_name", "pos", "v").repartitionByRange(parts, "column_name", "pos").withColumn("chunk", F.spark_partition_id())
    order = Window.partitionBy("column_name", "chunk").orderBy("pos")
    step = F.col("v") - F.lag("v").over(order)
    inner = ranged.withColumn("step", step).groupBy("column_name", "chunk").agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("bad"), F.count_if(F.col("step") > 0).alias("up"), F.count_if(F.abs(F.col("step") - 1) < 0.001).alias("next"),
        F.count_if(F.col("v") == F.floor("v")).alias("whole"), F.min_by("v", "pos").alias("first"), F.max_by("v", "pos").alias("last"),
    )
    border = F.col("first") - F.lag("last").over(Window.partitionBy("column_name").orderBy("chunk"))  # one row for each range
    joined = inner.withColumn("border", border).groupBy("column_name").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), (F.sum("up") + F.count_if(F.col("border") > 0)).alias("up"), (F.sum("next") + F.count_if(F.abs(F.col("border") - 1) < 0.001)).alias("next"),
        F.sum("whole").alias("whole"), F.min_by("first", "chunk").alias("first"),
    )
    unique = values.groupBy("column_name", "v").count().groupBy("column_name").agg(F.count("v").alias("unique"))
    n, gaps = F.col("n").cast("double"), F.nullif(F.col("n") - 1, F.lit(0)).cast("double")
    start = F.when(F.col("first").isin(0.0, 1.0), 0.1).when(F.col("first") < 10, 0.05).otherwise(0.0)
    score = F.col("unique") / n * 0.2 + F.col("up") / gaps * 0.25 + F.col("next") / gaps * 0.35 + start + F.col("whole") / n * 0.1
    made = F.when((F.col("n") <= 1) | (F.col("bad") > 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    out = joined.join(unique, "column_name").select("column_name", F.col("n").cast("bigint").alias("n"), F.round(made, 9).alias("confidence"))
    empty = long.select("column_name").distinct().join(out, "column_name", "left")
    return empty.select("column_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")).withColumn("is_index", F.col("confidence") >= threshold)


def scored_values(values: DataFrame) -> DataFrame:
    """Add is_gender, is_job and the hash score to distinct values (column_name, value, n)."""
    return with_hash_score(values).withColumns({"is_gender": is_gender(F.col("value")), "is_job": is_job_title(F.col("value"))})


def tallies(scored: DataFrame) -> DataFrame:
    """Sum the rows of scored values by what they vote for: a few rows for each column, which every vote can use."""
    flags = ["is_gender", "is_job", "is_hash", "is_strict"]
    scored = scored.withColumn("is_strict", F.col("is_hash") & (F.col("confidence") > STRICT_CONFIDENCE))
    key = F.concat_ws(",", *[F.col(c).cast("string") for c in flags], "hash_types")
    # Flags come out as aggregates: a filter on a grouping column would be pushed into the scores and copy them.
    return scored.groupBy("column_name", key.alias("key")).agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in flags], F.first("hash_types").alias("hash_types")).drop("key")


def votes(tally: DataFrame) -> DataFrame:
    """Return for each column its rows and the rows that vote for gender, job title and hash (loosely and strictly)."""
    held = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    made = tally.groupBy("column_name").agg(
        F.sum("n").cast("bigint").alias("n_rows"), held(F.col("is_gender")).alias("n_gender"), held(F.col("is_job")).alias("n_job_title"), held(F.col("is_hash")).alias("n_hash"),
        held(F.col("is_strict")).alias("n_hash_strict"),
    )
    return made.withColumns({f"{k}_ratio": ratio(F.col(f"n_{k}"), F.col("n_rows")) for k in ("gender", "job_title", "hash")})


def hash_type_counts(tally: DataFrame, strict: bool = False) -> DataFrame:
    """Return (column_name, type, count) of the kinds of the values that count as hashes."""
    counted = tally.filter("is_strict" if strict else "is_hash").select("column_name", "n", F.explode("hash_types").alias("type"))
    return counted.groupBy("column_name", "type").agg(F.sum("n").cast("bigint").alias("count"))


def most_frequent(counts: DataFrame, n: int, by: str = "column_name", item: str = "type", count: str = "count") -> DataFrame:
    """Return the ``n`` items of the highest counts in each group, ``rank`` from 1; of equals the first by name."""
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(count), F.asc(item))))
    return ranked.filter(F.col("rank") <= n)


#: A column's rows are dealt to so many parts before its sample is drawn.
SAMPLE_PARTS = 64


def sample_rows(long: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """Return ``n`` rows of each column, those of the smallest MD5 of place and seed; all if it has no more.

    Each part of a column gives its own ``n`` first, so no column is sorted in one task.
    """
    key = F.md5(F.concat(F.col("pos").cast("string"), F.lit(f":{seed}")).cast("binary"))
    out = long.withColumn("__key", key).withColumn("__part", F.pmod(F.xxhash64("pos"), F.lit(SAMPLE_PARTS)))
    for by in (("column_name", "__part"), ("column_name",)):
        out = out.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy("__key", "pos"))).filter(F.col("__at") <= n).drop("__at")
    return out.drop("__key", "__part")


def contiguous_block(long: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """Return a run of ``n`` rows of each column from a seeded place, missing ones dropped; the whole column if it has no more.

    Places must run from 0 without gaps, see ``sources.tables.with_positions``.
    """
    sizes = long.groupBy("column_name").agg(F.count("*").alias("size"))
    drawn = F.conv(F.substring(F.md5(F.concat("column_name", F.lit(f":{seed}")).cast("binary")), 1, 12), 16, 10).cast("bigint")
    start = F.pmod(drawn, F.greatest(F.col("size") - n + 1, F.lit(1)))
    starts = sizes.select("column_name", F.when(F.col("size") > n, start).otherwise(0).alias("start"))
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + n)
    return long.join(starts, "column_name").filter(inside & ~blank(F.col("value"))).select("column_name", "pos", "value")


def type_from_values(values: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Return (column_name, n_filled, field_type) by the forms of the values (column_name, value, n) that aren't blank.

    0 and 1 count as boolean and as integer, integers also as numbers; the
    first of boolean, integer (LONG past 32 bits) and number that reaches the
    threshold wins; a column without values is TEXT, others TEXT_WITH_KEYWORD.
    """
    filled = values.withColumn("filled", ~blank(F.col("value")))
    forms = {k: F.coalesce(F.sum(F.when(F.col("filled") & c, F.col("n"))), F.lit(0)) for k, c in value_forms(F.col("value")).items()}
    counts = filled.groupBy("column_name").agg(F.coalesce(F.sum(F.when(F.col("filled"), F.col("n"))), F.lit(0)).cast("bigint").alias("n_filled"), F.sum("n").alias("n_rows"), *[c.alias(k) for k, c in forms.items()])
    share = lambda k: F.col(k) >= threshold * F.col("n_filled")
    made = F.when(F.col("n_filled") == 0, "TEXT").when(share("boolean"), "BOOLEAN").when(share("integer"), F.when(F.col("long") > 0, "LONG").otherwise("INTEGER")).when(share("number"), "FLOAT").otherwise("TEXT_WITH_KEYWORD")
    return counts.select("column_name", "n_filled", made.alias("field_type"))


def type_from_values_literal(values: DataFrame) -> DataFrame:
    """Return (column_name, field_type) where one value of a form decides: integers count as BOOLEAN, then FLOAT."""
    forms = value_forms(F.col("value"))
    held = lambda c: F.coalesce(F.bool_or(~blank(F.col("value")) & c), F.lit(False))
    made = values.groupBy("column_name").agg(held(forms["boolean"] | forms["integer"]).alias("b"), held(forms["number"] & ~forms["integer"]).alias("f"))
    return made.select("column_name", F.when(F.col("b"), "BOOLEAN").when(F.col("f"), "FLOAT").otherwise("TEXT_WITH_KEYWORD").alias("field_type"))
