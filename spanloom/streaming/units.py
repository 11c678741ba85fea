"""Segmentation of documents as they arrive: every stage works on one document at a time, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.segment import segment


def stream_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units of text files that come into a folder."""
    docs = spark.readStream.option("wholetext", True).text(folder).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))
    return segment(docs)


def write_units(units: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to Parquet and ends; to be started again, or with another trigger for a running stream."""
    return units.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
