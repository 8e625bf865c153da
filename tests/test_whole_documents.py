"""Queries over documents leave out no page and no kind of file."""

import os

import pytest

from leafmill.plans.queries import LINES, QUERIES


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Documents of 0, 1, 2 and 101 pages, each in both syntaxes, whole and damaged."""
    at = str(tmp_path_factory.mktemp("long"))
    texts = ["", "one line", "\n".join(["x"] * (LINES + 1)), "\n".join(f"l{k}" for k in range(100 * LINES + 1))]
    rows = [(i, t, "s", "en") for n, t in enumerate(texts) for i in (100 * n + 1, 100 * n + 2, 14 * (n + 1), 14 * (n + 1) + 7)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(os.path.join(at, "documents.parquet"))
    return at, {i: t.split("\n") if t else [] for i, t, *_ in rows}


def _pages(lines):
    return max(1, -(-len(lines) // LINES))


@pytest.mark.parametrize("name", ["pdf_roundtrip_text", "pdf_roundtrip_window", "pdf_sql_pages"])
def test_every_page_has_a_row(spark, data, name):
    at, lines = data
    got = {(r["doc_id"], r["page_number"]) for r in QUERIES[name](spark, at).select("doc_id", "page_number").collect()}
    assert got == {(i, n + 1) for i, x in lines.items() if x or name != "pdf_roundtrip_window" for n in range(_pages(x))}


def test_whole_texts(spark, data):
    at, lines = data
    got = {r["doc_id"]: (r["text"].split(), r["n_pages"]) for r in QUERIES["pdf_document_text"](spark, at).collect()}
    assert got == {i: (" ".join(x).split(), _pages(x)) for i, x in lines.items()}


def test_cross_references_of_all_kinds_of_files(spark, data):
    """Catalogue, tree, info and three of the font, and two objects a page; the newer syntax has its two containers too."""
    at, lines = data
    got = {r["doc_id"]: r["n_in_use"] for r in QUERIES["pdf_xref_entries"](spark, at).collect()}
    assert got == {i: 6 + 2 * _pages(x) + 2 * (i % 2) for i, x in lines.items()}
