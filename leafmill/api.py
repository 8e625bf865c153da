"""Short names for the common paths: files or a binary column to results, Markdown, JSON and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.operators import formats
from leafmill.operators.parse import Options, extract_images, parse_buffers, parse_files
from leafmill.sources.pdf import from_column, read_files


def files_to_markdown(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """(doc_id, markdown) of the files under a path."""
    return formats.to_markdown(parse_files(spark, path, options))


def files_to_json(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """(doc_id, json) of the files under a path."""
    return formats.to_json(parse_files(spark, path, options))


def buffers_to_markdown(df: DataFrame, key: str, content: str, options: Options | None = None) -> DataFrame:
    """(doc_id, markdown) of the documents in a binary column."""
    return formats.to_markdown(parse_buffers(df, key, content, options))


def buffers_to_json(df: DataFrame, key: str, content: str, options: Options | None = None) -> DataFrame:
    """(doc_id, json) of the documents in a binary column."""
    return formats.to_json(parse_buffers(df, key, content, options))


def images_of_files(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """A row per image of the files under a path."""
    return extract_images(read_files(spark, path), options)


def images_of_buffers(df: DataFrame, key: str, content: str, options: Options | None = None) -> DataFrame:
    """A row per image of the documents in a binary column."""
    return extract_images(from_column(df, key, content), options)


__all__ = ["Options", "buffers_to_json", "buffers_to_markdown", "files_to_json", "files_to_markdown", "images_of_buffers", "images_of_files", "parse_buffers", "parse_files"]
