"""Formatting is stateless, so a stream goes through the same columns as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.registry import Request
from inkstone.operators.text import format_column, native_format


def format_stream(stream: DataFrame, text_col: str, request: Request | str = "defaults", native: bool = False) -> DataFrame:
    """A stream or a table with its text formatted in place."""
    col = F.col(text_col)
    return stream.withColumn(text_col, native_format(col, request) if native else format_column(col, request))


def run_available(spark: SparkSession, source: str, sink: str, checkpoint: str, text_col: str, request, native: bool = False) -> None:
    """Formats all Parquet files that ``source`` has now into ``sink``, exactly once."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    query = format_stream(stream, text_col, request, native).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
