"""What the operators share: reading a table, shared folders, joins on hot keys, Arrow batch bounds, and batch assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.shared import delete, new_folder, scope, shared_root, written

__all__ = ["arrow_schema", "bound_batches", "delete", "map_batches", "discard", "hot_join", "new_folder", "scope", "shared_root", "table", "written"]

#: Rows and bytes of one Arrow batch, so that a batch of very long texts still fits a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(*tables: DataFrame) -> None:
    """Remove what ``written`` tables hold; they can't be read any more."""
    for table_ in tables:
        if files := table_.inputFiles():
            delete(table_.sparkSession, files[0].rpartition("/")[0])


#: A key is hot if it has more than this share of the rows, so at most ``1 / HOT_SHARE`` keys are; few rows have none.
HOT_SHARE, HOT_ROWS = 1 / 1000, 256


def hot_keys(df: DataFrame, key: str) -> list:
    """Return the hot values of ``key`` that aren't null: at most a thousand."""
    least = max(HOT_ROWS, int(df.count() * HOT_SHARE))
    return [r[0] for r in df.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > least).select(key).collect()]


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``left`` (a written table) to ``right`` (a row a key) without bringing a hot key together.

    Hot keys' rows of ``right``, at most a thousand, are broadcast; the rest is joined as Spark sees fit.
    """
    hot = hot_keys(left, key)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.filter(~is_hot).join(right.filter(~is_hot), key, how).unionByName(left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how))


#: Rows of ids or hashes, of some 16 bytes each, up to which they may be broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """Return ``df`` (rows of a few numbers) marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``make`` (record batch -> column lists) to every Arrow batch of ``df``."""
    bound_batches(df.sparkSession)
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = make(batch)
                yield pa.record_batch([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
