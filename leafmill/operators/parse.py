"""Documents to tables: the parsing kernel in Arrow batches, then everything from runs on as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leafmill import schema
from leafmill.functions import clean as cleaning
from leafmill.functions.dates import pdf_date
from leafmill.functions.layout import layout_runs, sorted_runs
from leafmill.kernel import document as kernel
from leafmill.sources.pdf import MAX_SAFE_SIZE, from_column, read_files

#: Documents of one output batch, and bytes of their contents: results are larger than their input.
BATCH_DOCUMENTS, BATCH_BYTES = 64, 4 << 20
# The text of a page that fails, and of a document over the size limit.
FAILED_PAGE = "[Error extracting page content]"
TOO_LARGE = {"file": "PDF file too large for complete text extraction", "buffer": "PDF buffer too large for complete text extraction"}


@dataclass(frozen=True)
class Options:
    """Limits per document; what to extract; clean: 'none' or 'swedish'; order: 'content' or 'position'; compat: matrices and streams as in older releases."""

    max_pages: int = 100
    max_safe_size: int = MAX_SAFE_SIZE
    max_images: int = 50
    what: frozenset[str] = frozenset(["text", "images"])
    clean: str = "none"
    order: str = "content"
    compat: bool = False


def _key_type(df: DataFrame) -> T.DataType:
    return df.schema["doc_id"].dataType


def _batches(ids, contents):
    """Row numbers in groups of a bounded number of documents and bytes."""
    held, size = [], 0
    for i in range(len(ids)):
        held.append(i)
        size += len(contents[i].as_py() or b"") if contents[i].is_valid else 0
        if len(held) >= BATCH_DOCUMENTS or size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def parse_raw(documents: DataFrame, options: Options | None = None) -> DataFrame:
    """(doc_id, version, status, error, metadata, pages of runs) of each row of (doc_id, length, content).

    No shuffle, but for rows that come in fewer partitions than there are cores (spread). Null and empty contents, and those
    that are no document, have status error; those over the size limit, which are not parsed, too_large. Ids may be null or
    repeat; an empty table gives no rows; other columns are not looked at.
    """
    o = options or Options()
    out = T.StructType([T.StructField("doc_id", _key_type(documents)), *schema.PARSED.fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            ids, contents, over = batch.column(0), batch.column(1), batch.column(2)
            for rows in _batches(ids, contents):
                found = [{"doc_id": ids[i].as_py()} | (_too_large() if over[i].as_py() else kernel.parse(contents[i].as_py() or b"", o.max_pages, o.what, o.compat)) for i in rows]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return spread(_guarded(documents, o.max_safe_size)).mapInArrow(run, out)


def _guarded(documents: DataFrame, max_safe_size: int) -> DataFrame:
    """(doc_id, content, over): contents over the size limit, by length, don't reach Python."""
    over = F.coalesce(F.col("length") > max_safe_size, F.lit(False))
    return documents.select("doc_id", F.when(~over, F.col("content")).alias("content"), over.alias("over"))


def _too_large() -> dict:
    return kernel.failure(kernel.NotAPdf("over the size limit")) | {"status": "too_large", "error": None}


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores if they come in fewer partitions, as from one large row group; rows themselves otherwise.

    A plan with an exchange, and a stream, are left as they are; so are many partitions, so a large table is never shuffled.
    """
    if rows.isStreaming:
        return rows
    plan, cores = rows._jdf.queryExecution(), rows.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return rows
    return rows.repartition(4 * cores)


def page_text(streams: Column, options: Options) -> Column:
    """Text of a page's streams: each laid out, and cleaned if asked for, joined by line breaks."""

    def one(runs: Column) -> Column:
        text = layout_runs(sorted_runs(runs) if options.order == "position" else runs)
        return cleaning.swedish(text) if options.clean == "swedish" else text

    return F.array_join(F.transform(streams, one), "\n")


def _metadata(m: Column) -> Column:
    texts = [m[n].alias(n) for n in ("title", "author", "subject", "keywords", "creator", "producer")]
    return F.struct(*texts, pdf_date(m["creation_date"]).alias("creation_date"), pdf_date(m["modification_date"]).alias("modification_date"), m["page_count"].alias("page_count"), m["is_encrypted"].alias("is_encrypted"))


def _stub_page(kind: str) -> Column:
    images = F.array().cast(T.ArrayType(schema.IMAGE))
    return F.struct(F.lit(1).alias("page_number"), F.lit(TOO_LARGE[kind]).alias("text"), images.alias("images"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"))


def _stub(documents: DataFrame, kind: str) -> DataFrame:
    """The result of documents over the size limit: one page with a sentence. Their content is not read."""
    text, none = F.lit(TOO_LARGE[kind]), F.lit("")
    images = F.array().cast(T.ArrayType(schema.IMAGE))
    moment = F.lit(None).cast("timestamp")
    metadata = F.struct(*(none.alias(n) for n in ("title", "author", "subject", "keywords", "creator", "producer")), moment.alias("creation_date"), moment.alias("modification_date"), F.lit(0).alias("page_count"), F.lit(False).alias("is_encrypted"))
    page = _stub_page(kind)
    return documents.select("doc_id", F.lit(None).cast("string").alias("version"), F.lit("too_large").alias("status"), F.lit(None).cast("string").alias("error"), text.alias("text"), F.array(page).alias("pages"), images.alias("images"), metadata.alias("metadata"))


def result(parsed: DataFrame, options: Options | None = None, kind: str = "buffer") -> DataFrame:
    """doc_id, version, status, error, text, pages, images, metadata from parse_raw's rows; all native, within the row.

    A document over the size limit gets one page with a sentence, which kind ('file' or 'buffer') words.
    """
    o = options or Options()
    page = lambda p: F.struct(
        p["page_number"].alias("page_number"), F.when(p["failed"], FAILED_PAGE).otherwise(page_text(p["streams"], o)).alias("text"),
        p["images"].alias("images"), p["width"].alias("width"), p["height"].alias("height"),
    )
    laid = parsed.withColumn("pages", F.when(F.col("status") == "too_large", F.array(_stub_page(kind))).otherwise(F.transform("pages", page)))
    images = F.slice(F.flatten(F.transform("pages", lambda p: p["images"])), 1, o.max_images)
    return laid.select(
        "doc_id", "version", "status", "error", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("text"), "pages",
        images.alias("images"), _metadata(F.col("metadata")).alias("metadata"),
    )


def parse(documents: DataFrame, options: Options | None = None, kind: str = "buffer") -> DataFrame:
    """The result of every document (doc_id, length, content); one over max_safe_size gets a stub, a broken one its status."""
    o = options or Options()
    if kind == "buffer":
        return result(parse_raw(documents, o), o)
    # Files are read twice, by length: the filter reaches the scan, so the contents of large ones are never read.
    small, large = documents.where(F.col("length") <= o.max_safe_size), documents.where(F.col("length") > o.max_safe_size)
    return result(parse_raw(small, o), o, kind).unionByName(_stub(large, kind))


def parse_files(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """Results of all files under a path, doc_id being theirs."""
    return parse(read_files(spark, path), options, "file")


def parse_buffers(df: DataFrame, key: str, content: str, options: Options | None = None) -> DataFrame:
    """Results of the documents in a binary column."""
    return parse(from_column(df, key, content), options)


def extract_images(documents: DataFrame, options: Options | None = None) -> DataFrame:
    """(doc_id, image_no, image columns): a row per image, up to max_images a document. Text is not interpreted."""
    o = options or Options()
    o = Options(o.max_pages, o.max_safe_size, o.max_images, frozenset(["images"]), compat=o.compat)
    rows = parse(documents, o).select("doc_id", F.posexplode("images").alias("image_no", "image"))
    return rows.select("doc_id", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "image.page_number", "image.name"), 256).alias("id"), "image_no", "image.*")


def text_runs(parsed: DataFrame) -> DataFrame:
    """(doc_id, page_number, stream_no, seq, run columns): parse_raw's runs, a row each."""
    pages = parsed.select("doc_id", F.explode("pages").alias("page"))
    streams = pages.select("doc_id", "page.page_number", F.posexplode("page.streams").alias("stream_no", "runs"))
    return streams.select("doc_id", "page_number", "stream_no", F.posexplode("runs").alias("seq", "run")).select("doc_id", "page_number", "stream_no", "seq", "run.*")


def inspect(documents: DataFrame, kind: str, max_safe_size: int = MAX_SAFE_SIZE) -> DataFrame:
    """An inspection table of the documents' insides: 'xref', 'objects', 'operations' or 'fonts'.

    Contents that are null, no document or over max_safe_size have no rows.
    """
    out = T.StructType([T.StructField("doc_id", _key_type(documents)), *schema.INSPECTIONS[kind].fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            ids, contents = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                doc_id, rows = ids[i].as_py(), kernel.inspect(contents[i].as_py() or b"", kind)
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id} | r for r in rows[a : a + 10_000]], schema=arrow)

    return spread(_guarded(documents, max_safe_size)).mapInArrow(run, out)
