"""Fixture documents: table rows written as PDF bytes, in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.kernel import writer as kernel
from leafmill.operators.parse import spread

BATCH = 256


def write_documents(rows: DataFrame, key: str, text: str, title: str | None = None, author: str | None = None, created: str | None = None, lines_per_page: int = kernel.LINES_PER_PAGE) -> DataFrame:
    """(doc_id, length, content): each row's text as a document. Odd keys are written in the newer syntax, every seventh is damaged."""
    none = F.lit("")
    column = lambda c: F.coalesce(F.col(c).cast("string"), none) if c else none
    source = rows.select(F.col(key).cast("long").alias("doc_id"), column(text).alias("text"), column(title).alias("title"), column(author).alias("author"), column(created).alias("created"))

    return _written(
        source, lambda x: kernel.text_pdf(x["text"], x["title"], x["author"], x["created"], modern=bool((x["doc_id"] or 0) % 2), lines_per_page=lines_per_page, damaged=(x["doc_id"] or 0) % 7 == 0)
    )


def _written(source: DataFrame, write) -> DataFrame:
    """(doc_id, length, content) of each row of source, written by write(row)."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                out = [write(x) for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in out], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "length", "content"])

    return spread(source).mapInArrow(run, "doc_id long, length long, content binary")


def write_operators(rows: DataFrame, key: str, text: str, title: str) -> DataFrame:
    """(doc_id, length, content): each row's text, its lines shown by all operators in turn. Every fifth has a second revision with another title, every eleventh an encryption entry."""
    none = F.lit("")
    source = rows.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), none).alias("text"), F.coalesce(F.col(title).cast("string"), none).alias("title"))
    return _written(source, lambda x: kernel.operators_pdf(x["text"], x["title"], f"{x['title']} revised" if (x["doc_id"] or 0) % 5 == 0 else None, (x["doc_id"] or 0) % 11 == 0))


def write_malformed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, length, content): sound documents, malformed ones of each kind and no documents, by the key modulo 9."""
    source = rows.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return _written(source, lambda x: kernel.malformed_pdf(x["text"], (x["doc_id"] or 0) % (len(kernel.MALFORMED) + 2)))
