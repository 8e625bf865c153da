"""Sinks: results as Markdown and JSON text, and images as files. The texts are column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Images listed in a Markdown text.
MANIFEST = 20


def normalize(text: Column) -> Column:
    """Line ends as \\n, at most one blank line in a row, no blanks at line ends."""
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unix, "\n{3,}", "\n\n"), "(?md)[\t ]+$", "")


def markdown(metadata: Column, pages: Column, images: Column) -> Column:
    """The Markdown text of a result."""
    title = F.trim(F.coalesce(metadata["title"], F.lit("")))
    entry = lambda label, v: F.when(F.length(v) > 0, F.concat(F.lit(f"- {label}: "), v))
    lines = [entry("Author", metadata["author"]), entry("Producer", metadata["producer"]), entry("Creator", metadata["creator"]), F.concat(F.lit("- Pages: "), metadata["page_count"].cast("string"))]
    listed = F.filter(F.array(*lines), lambda x: x.isNotNull())
    head = F.when(F.length(title) > 0, F.array(F.concat(F.lit("# "), title))).otherwise(F.array().cast("array<string>"))
    above = F.when(F.length(F.coalesce(metadata["title"], F.lit(""))) > 0, F.lit("")).otherwise(F.lit("# Document"))
    summary = F.when(F.size(listed) > 0, F.concat(F.array(above, F.lit("## Metadata")), listed)).otherwise(F.array().cast("array<string>"))
    body = F.flatten(F.transform(pages, lambda p: F.array(F.lit(""), F.concat(F.lit("## Page "), p["page_number"].cast("string")), F.lit(""), normalize(p["text"]))))
    shown = F.transform(F.slice(images, 1, MANIFEST), lambda i: F.concat(F.lit("- Page "), i["page_number"], F.lit(": "), i["width"], F.lit("x"), i["height"], F.lit(" ("), i["mime_type"], F.lit(")")))
    more = F.when(F.size(images) > MANIFEST, F.array(F.concat(F.lit("- ...and "), F.size(images) - MANIFEST, F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    manifest = F.when(F.size(images) > 0, F.concat(F.array(F.lit(""), F.lit("## Images"), F.concat(F.lit("Total images: "), F.size(images))), shown, more)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, summary, body, manifest), "\n")


def json_text(text: Column, pages: Column, images: Column, metadata: Column) -> Column:
    """The JSON text of a result; bytes are base64."""
    return F.to_json(F.struct(text.alias("text"), pages.alias("pages"), images.alias("images"), metadata.alias("metadata")), {"pretty": "true"})


def to_markdown(results: DataFrame) -> DataFrame:
    """(doc_id, markdown) of results."""
    return results.select("doc_id", markdown(F.col("metadata"), F.col("pages"), F.col("images")).alias("markdown"))


def to_json(results: DataFrame) -> DataFrame:
    """(doc_id, json) of results."""
    return results.select("doc_id", json_text(F.col("text"), F.col("pages"), F.col("images"), F.col("metadata")).alias("json"))


def image_names(images: DataFrame) -> DataFrame:
    """extract_images' rows with the name of each one's file."""
    kind = F.when(F.col("mime_type") == "image/jpeg", "jpg").when(F.col("mime_type") == "image/png", "png").otherwise("bin")
    number = (F.col("image_no") + 1).cast("string")
    return images.withColumn("file_name", F.concat(F.lit("image_"), number, F.lit("_p"), "page_number", F.lit("_"), "width", F.lit("x"), "height", F.lit("."), kind))


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Write each image under folder/<hash of doc_id>/; returns (doc_id, path). Names are by content, so repeated tasks write the same.

    A folder without a scheme is on the cluster's default file system.
    """
    import pyarrow as pa

    jvm = images.sparkSession.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    folder = re.sub("^file:/+", "file:///", place.getFileSystem(images.sparkSession.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString())
    named = image_names(images).withColumn("place", F.concat(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16), F.lit("/"), "file_name"))

    def run(batches):
        import pyarrow.fs as pafs

        fs, inner = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = []
            for place, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                path = f"{inner}/{place}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(data or b"")
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["doc_id", "path"])

    return named.select("doc_id", "place", "data").mapInArrow(run, f"doc_id {images.schema['doc_id'].dataType.simpleString()}, path string")
