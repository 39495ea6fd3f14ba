"""The whole classification: categories and a field type for every column of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.config import Config
from colsense.functions.names import column_metadata
from colsense.functions.types import type_of_categories
from colsense.operators import columns as C
from colsense.operators.pii import frequencies
from colsense.shared import written
from colsense.sources.tables import column_names, distinct_values, to_long, with_positions


def classify_columns(df: DataFrame, order: Column | str | None = None, config: Config = Config(), columns: list[str] | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """Return (column_name, name, categories, field_type) for each of ``columns`` (all) of ``df``.

    Categories: index first, then the sorted others: gender, job-title, hash
    with its most frequent kinds, and id; where none of gender, job-title and
    hash is found, the most frequent kind of personal data.  Field type: that
    named in the column's name, else that of the categories, else of the values.

    The distinct values are written once, and everything but the index is taken
    from them.  Cheap votes come first; only the columns that they leave open
    are searched for personal data, names of a ``dictionary`` (type, term)
    included.  With ``config.block_size`` the index is judged by a run of rows.
    """
    wanted = columns or df.columns
    long = to_long(df, wanted, order)
    seen = C.sample_rows(long, config.sample_size, config.seed) if config.sample_size else long
    values = written(distinct_values(seen), "values")
    tally = C.tallies(C.scored_values(values))
    voted = C.votes(tally)
    marks = voted.select(
        "column_name", (F.col("gender_ratio") > config.gender).alias("gender"), (F.col("job_title_ratio") > config.job_title).alias("job"), (F.col("hash_ratio") > config.hash).alias("hash"),
    )
    hash_types = C.most_frequent(C.hash_type_counts(tally), config.hash_types).groupBy("column_name").agg(F.collect_list("type").alias("kinds"))
    marks = marks.join(hash_types, "column_name", "left").collect()  # a row for each column
    open_ = [r.column_name for r in marks if not (r.gender or r.job or r.hash)]
    cheap = df.sparkSession.createDataFrame(
        [(r.column_name, ["gender"] * r.gender + ["job-title"] * r.job + (["hash", *sorted(r.kinds or [])] if r.hash else [])) for r in marks], "column_name string, cheap array<string>",
    )
    rows = C.contiguous_block(with_positions(long), config.block_size, config.seed) if config.block_size else long
    names = column_names(df.select(*[F.col(f"`{c}`") for c in wanted]))
    out = names.join(cheap, "column_name", "left").join(C.profile_of_values(values).select("column_name", "is_id"), "column_name", "left")
    out = out.join(C.index_confidence(rows, config.index).select("column_name", "is_index"), "column_name", "left").join(C.type_from_values(values, config.types), "column_name", "left")
    if open_:
        top = C.most_frequent(frequencies(values.filter(F.col("column_name").isin(open_)), dictionary=dictionary), 1, count="n_spans").select("column_name", F.col("type").alias("pii"))
        out = out.join(top, "column_name", "left")
    else:
        out = out.withColumn("pii", F.lit(None).cast("string"))
    rest = F.array_compact(F.concat(F.coalesce("cheap", F.array().cast("array<string>")), F.array(F.col("pii"), F.when(F.col("is_id"), F.lit("id")))))
    hint = column_metadata(F.col("column_name"))
    found = F.concat(F.when(F.col("is_index"), F.array(F.lit("index"))).otherwise(F.array().cast("array<string>")), hint["categories"], F.array_sort(rest))
    out = out.withColumn("name", hint["column_name"]).withColumn("hint", hint["field_type"]).withColumn("categories", F.array_distinct(found))
    from_categories = type_of_categories(F.col("categories"))
    kind = F.when(F.col("hint") != "UNKNOWN", F.col("hint")).when(F.coalesce(F.col("n_filled"), F.lit(0)) == 0, "TEXT").when(from_categories != "UNKNOWN", from_categories).otherwise(F.col("field_type"))
    return out.orderBy("position").select("column_name", "name", "categories", kind.alias("field_type"))
