"""Secured streams: the batch rules applied to an unbounded frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewarden.operators.enforce import SecurityState, secure
from tablewarden.operators.membership import Who


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream; new files are new rows."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def secure_stream(
    stream: DataFrame, table: tuple[str, str, str], state: SecurityState, principal: str | Who
) -> DataFrame:
    """What *principal* sees of a stream of rows of *table*.

    Append-only, row by row: no state, no watermark.  Rules and groups are
    settled when the query starts; restart it to take up changed ones.
    """
    return secure(stream, table, state, principal)


def write_available(secured: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet, exactly once, and stop.

    *checkpoint* and *path* must be folders that all executors share.
    """
    return (
        secured.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
