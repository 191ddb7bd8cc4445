"""Streaming ingest: passages that arrive as files are appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.store import insert_missing


def stream_passages(spark: SparkSession, path: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Append passages of Parquet files under ``path`` to ``target`` (Parquet); ids that are there stay out.

    Each batch is anti-joined to the table, so that a batch that runs again after a failure adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        try:
            stored = spark.read.schema(schema).parquet(target)
            stored.limit(0).count()
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
            stored = spark.createDataFrame([], schema)
        insert_missing(batch, stored).write.mode("append").parquet(target)

    read = spark.readStream.schema(schema).parquet(path)
    return read.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
