"""Tracer signals over a stream: the scalar operators hold no state, so they run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tracer import tracer


def tracer_stream(source: DataFrame, baseline: str, post: str, signal_type: str) -> DataFrame:
    """source (streaming or not) with column `values`, the tracer signal; rows without one are dropped."""
    return source.withColumn("values", tracer(F.col(baseline), F.col(post), signal_type)).where("values IS NOT NULL")


def write_tracer(spark: SparkSession, path: str, schema, out: str, checkpoint: str, baseline: str, post: str, signal_type: str) -> None:
    """Append the signals of all Parquet files below path that are new since the checkpoint to out."""
    rows = tracer_stream(spark.readStream.schema(schema).parquet(path), baseline, post, signal_type)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
