"""Sources of document bytes: files, a stream of files, a binary column, and the data source format 'pdf'."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafmill.kernel import document as kernel

MAX_SAFE_SIZE = 20 * 1024 * 1024
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(doc_id, length, content) of the files under a path; doc_id is the file's path. A filter on length reaches the scan."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("doc_id"), "length", "content")


def read_file_stream(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream: new files under the path, a bounded number a batch."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.col("path").alias("doc_id"), "length", "content")


def from_column(df: DataFrame, key: str, content: str) -> DataFrame:
    """(doc_id, length, content) of a binary column, null counting as empty."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return df.select(F.col(key).alias("doc_id"), F.octet_length(data).cast("long").alias("length"), data.alias("content"))


class _Chunk(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.max_pages, self.files = options["path"], int(options.get("maxpages", 100)), int(options.get("filespertask", 32))
        self.max_safe_size = int(options.get("maxsafesize", MAX_SAFE_SIZE))
        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", self.path):
            raise ValueError(f"a path with a scheme is needed, as in file:///data or hdfs:///data: {self.path}")

    def partitions(self):
        import pyarrow.fs as pafs

        fs, inner = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(inner)
        names = [inner] if info.type == pafs.FileType.File else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.type == pafs.FileType.File and f.path.lower().endswith(".pdf"))
        return [_Chunk(names[i : i + self.files]) for i in range(0, len(names), self.files)] or [_Chunk([])]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs = pafs.FileSystem.from_uri(self.path)[0]
        for name in partition.paths:
            with fs.open_input_file(name) as f:
                if f.size() > self.max_safe_size:
                    continue
                found = kernel.parse(f.read(), self.max_pages, frozenset(["text"]))
            for page in found["pages"]:
                for stream_no, runs in enumerate(page["streams"]):
                    for seq, r in enumerate(runs):
                        yield (name, page["page_number"], stream_no, seq, r["text"], r["x"], r["y"], r["width"], r["font_size"], r["char_spacing"], r["word_spacing"])


class PdfDataSource(DataSource):
    """spark.read.format('pdf').load(path): a row per text run, after spark.dataSource.register(PdfDataSource).

    For folders that one listing fits into; parse_files reads more, through Spark's own scan. The path has a scheme. Files over
    the option maxSafeSize, and those that can't be read, have no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return "doc_id string, page_number int, stream_no int, seq int, text string, x double, y double, width double, font_size double, char_spacing double, word_spacing double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
