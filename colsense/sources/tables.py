"""Sources: CSV and Parquet as text columns, and the long form (column_name, pos, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsense.shared import written


class InvalidFileType(ValueError):
    """The path doesn't name a CSV file."""


def check_csv_path(path: str) -> str:
    """Return ``path`` if it ends with .csv in any case; whether it exists is Spark's to say when it is read."""
    if not path.lower().rstrip("/").endswith(".csv"):
        raise InvalidFileType(f"not a .csv file: {path}")
    return path


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Read a CSV with a header, all columns as text; empty cells are null."""
    return spark.read.options(header=True, inferSchema=False, **options).csv(check_csv_path(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return as_text(spark.read.parquet(path))


def as_text(df: DataFrame) -> DataFrame:
    """Cast every column to text; those that have no text form (arrays, maps, structs) become JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[(F.to_json(_quoted(f.name)) if isinstance(f.dataType, nested) else _quoted(f.name).cast("string")).alias(f.name) for f in df.schema])


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def column_names(df: DataFrame) -> DataFrame:
    """Return (position, column_name) of each column: the initial metadata."""
    rows = [(i, c) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string")


def to_long(df: DataFrame, columns: list[str] | None = None, order: Column | str | None = None) -> DataFrame:
    """Return (column_name, pos, value) of ``columns`` of ``df``.

    ``order`` gives the rows' places (a number that is unique); without it the
    order of files and of rows in them is taken.
    """
    pos = F.monotonically_increasing_id() if order is None else (F.col(order) if isinstance(order, str) else order).cast("bigint")
    names = columns or df.columns
    text = as_text(df.select(*[_quoted(c) for c in names], pos.alias("__pos"))).withColumn("__pos", F.col("__pos").cast("bigint"))
    return text.unpivot(["__pos"], [_quoted(c) for c in names], "column_name", "value").select("column_name", F.col("__pos").alias("pos"), "value")


def distinct_values(long: DataFrame) -> DataFrame:
    """Return (column_name, value, n): each distinct value once, with its rows, so that it is scored once."""
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def with_positions(long: DataFrame, chunks: int = 64) -> DataFrame:
    """Replace ``pos`` by 0, 1, ... in each column, by ranges: no column is sorted in one task."""
    # Written, as the ranges are sampled anew by each plan that reads them.
    ranged = written(long.repartitionByRange(chunks, "column_name", "pos").withColumn("chunk", F.spark_partition_id()), "ranges")
    starts = ranged.groupBy("column_name", "chunk").count()
    before = Window.partitionBy("column_name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("column_name", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("column_name", "chunk").orderBy("pos")
    placed = ranged.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["column_name", "chunk"])
    return placed.select("column_name", (F.col("start") + F.col("at")).alias("pos"), "value")
