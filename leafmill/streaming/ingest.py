"""Continuous ingestion: new files to parsed results. Every step up to the sink is stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators.parse import Options, parse
from leafmill.sources.pdf import read_file_stream


def parsed_stream(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """Results of new files under path, as a stream."""
    return parse(read_file_stream(spark, path), options, "file")


def ingest(spark: SparkSession, path: str, table_path: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Append results of all files that are there now to Parquet, exactly once, and stop."""
    stream = parsed_stream(spark, path, options).writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()
