"""Per-value scores over a stream: every predicate here needs one row only, so a stream takes it as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsense.functions.hashing import with_hash_score
from colsense.functions.predicates import is_gender, is_job_title


def scored_stream(stream: DataFrame, value: str) -> DataFrame:
    """Add is_gender, is_job_title and the hash score of column ``value`` to a batch or streaming frame."""
    made = with_hash_score(stream, value)
    return made.withColumns({"is_gender": is_gender(F.col(value)), "is_job_title": is_job_title(F.col(value))})


def windowed_votes(stream: DataFrame, value: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Return rows and votes of ``value`` for each window of ``time``; rows later than ``late`` are dropped by the watermark."""
    held = lambda c: F.count_if(c)
    counted = scored_stream(stream, value).withWatermark(time, late).groupBy(F.window(time, window))
    return counted.agg(F.count("*").alias("n_rows"), held(F.col("is_gender")).alias("n_gender"), held(F.col("is_job_title")).alias("n_job_title"), held(F.col("is_hash")).alias("n_hash"))
