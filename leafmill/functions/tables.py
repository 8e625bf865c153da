"""Table functions for SQL: SELECT d.id, p.* FROM docs d, LATERAL pdf_pages(d.content) p.

Null contents, those that are no document and those over MAX_SAFE_SIZE have no rows; none of them fails.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from leafmill.kernel import document as kernel
from leafmill.sources.pdf import MAX_SAFE_SIZE

#: A limit that no document reaches, for whole documents.
ALL_PAGES = 2**31 - 1


def _within(content: bytes | None) -> bytes:
    """The content, or nothing if it is over the size limit."""
    return bytes(content) if content and len(content) <= MAX_SAFE_SIZE else b""


@udtf(returnType="page_number int, width double, height double, n_runs int, n_images int")
class PdfPages:
    """A row per page of a document."""

    def eval(self, content: bytes):
        for p in kernel.parse(_within(content), ALL_PAGES)["pages"]:
            yield p["page_number"], p["width"], p["height"], sum(map(len, p["streams"])), len(p["images"])


@udtf(returnType="page_number int, stream_no int, seq int, text string, x double, y double, width double, font_size double, char_spacing double, word_spacing double")
class PdfRuns:
    """A row per text run of a document."""

    def eval(self, content: bytes):
        for p in kernel.parse(_within(content), ALL_PAGES, what=frozenset(["text"]))["pages"]:
            for n, runs in enumerate(p["streams"]):
                for seq, r in enumerate(runs):
                    yield (p["page_number"], n, seq, *r.values())


@udtf(returnType="page_number int, stream_no int, seq int, operator string, operands array<string>")
class PdfOperations:
    """A row per content operation of a document."""

    def eval(self, content: bytes):
        for r in kernel.inspect(_within(content), "operations"):
            yield tuple(r.values())


@udtf(returnType="number int, generation int, kind string, type string, value string, stream_length bigint")
class PdfObjects:
    """A row per object of a document."""

    def eval(self, content: bytes):
        for r in kernel.inspect(_within(content), "objects"):
            yield tuple(r.values())


def register(spark: SparkSession) -> None:
    """The table functions by name."""
    for name, f in (("pdf_pages", PdfPages), ("pdf_runs", PdfRuns), ("pdf_operations", PdfOperations), ("pdf_objects", PdfObjects)):
        spark.udtf.register(name, f)
