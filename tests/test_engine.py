"""The DataFrame side: options, layout, clean-up, formats, sources, streaming."""

import json
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import clean, dates, filters, images, layout
from leafmill.kernel import writer
from leafmill.operators import formats
from leafmill.operators.parse import TOO_LARGE, Options, extract_images, parse, parse_buffers, parse_files, parse_raw, text_runs
from leafmill.schema import RUN
from leafmill.sources.pdf import PdfDataSource, from_column
from leafmill.streaming.ingest import ingest


def _documents(spark, *contents):
    return from_column(spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "k long, c binary"), "k", "c")


def _layout(spark, runs, f=layout.layout_runs):
    df = spark.createDataFrame([(runs,)], "runs array<" + RUN.simpleString() + ">")
    return df.select(f(F.col("runs"))).first()[0]


CASES = [
    ([("ab", 0, 0, 10, 10, 0, 0), ("cd", 13, 0, 10, 10, 0, 0)], "ab cd"), ([("ab", 0, 0, 10, 10, 0, 0), ("cd", 11, 0, 10, 10, 0, 0)], "abcd"),
    ([("ab", 0, 0, 10, 10, 0, 0), ("cd", 13, 6, 10, 10, 0, 0)], "ab\ncd"), ([("ab", 0, 0, 10, 10, 0, 0), ("cd", 13, 5, 10, 10, 0, 0)], "ab cd"),
    ([("a", 1, 0, 5, 10, 0, 0), ("b", 12, 0, 5, 10, 0, 0)], "ab"), ([("a", 1, 0, 5, 10, 0, 0), ("b", 14, 0, 5, 10, 0, 0)], "a b"),
    ([("1", 1, 0, 5, 10, 0, 0), ("2", 14, 0, 5, 10, 2, 0)], "12"), ([("ab", 0, 0, 10, 10, 0, 0), ("c", 15, 0, 5, 10, 0, 0)], "abc"),
    ([("ab", 0, 0, 10, 10, 0, 0), ("c", 17, 0, 5, 10, 0, 0)], "ab c"), ([("ab", 0, 0, 10, 0, 0, 0), ("cd", 12.3, 0, 10, 0, 0, 0)], "abcd"),
    ([("ab", -10, 0, 10, 10, 0, 0), ("cd", 50, 0, 10, 10, 0, 0)], "abcd"), ([("", 1, 0, 0, 10, 0, 0), ("cd", 9, 0, 10, 10, 0, 0)], " cd"), ([], ""),
]


@pytest.mark.parametrize(("runs", "expected"), CASES)
def test_layout_rules(spark, runs, expected):
    runs = [(t, float(x), float(y), float(w), float(s), float(c), float(ws)) for t, x, y, w, s, c, ws in runs]
    assert _layout(spark, runs) == expected


def test_sorted_layout(spark):
    runs = [("low", 0.0, 10.0, 20.0, 10.0, 0.0, 0.0), ("right", 50.0, 100.0, 20.0, 10.0, 0.0, 0.0), ("left", 0.0, 101.0, 20.0, 10.0, 0.0, 0.0)]
    assert _layout(spark, runs, lambda r: layout.layout_runs(layout.sorted_runs(r))) == "left right\nlow"


def test_clean(spark):
    texts = ["Företag s namn", "the quick brown fox", "bolags s namn", "Objektetsregis treringsdatum", "KontaktMed oss", "Detaljplanernasregistrets" + "bestammelser", "abc"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(clean.swedish(F.col("t"))).collect()]
    assert got[0] == "Företagsnamn" and got[1] == "thequick brownfox" and got[4] == "Kontakt Medoss" and got[6] == "abc"


def test_merge_letter_against_python(spark):
    letter = "[a-zA-ZäöåÄÖÅ]"

    def merge(text):
        return re.sub(f"({letter}{{2,}}) ({letter}) ({letter}{{2,}})", lambda m: m.group(0) if m.group(1).endswith(m.group(2)) else m.group(1) + m.group(2) + m.group(3), text)

    texts = ["ab c de f gh", "abc c de f gh", "aa a aa a aa", "xy z zz y yy y y yy", "å ö ä åä ö öö"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(clean.merge_letter(F.col("t"))).collect()]
    assert got == [merge(t) for t in texts]


@pytest.mark.parametrize(("value", "expected"), [("D:20200102030405Z", "2020-01-02 03:04:05"), ("2020", "2020-01-01 00:00:00"), ("D:20201301", "2021-01-01 00:00:00"), ("D:20200230", "2020-03-01 00:00:00"), ("D:0099", "1999-01-01 00:00:00"), ("D:202002x1", "2020-02-01 00:00:00"), ("junk", "1900-01-01 00:00:00"), (None, None)])
def test_dates(spark, value, expected):
    got = spark.createDataFrame([(value,)], "v string").select(dates.pdf_date(F.col("v")).cast("string")).first()[0]
    assert got == expected


def test_filters_and_null(spark):
    df = spark.createDataFrame([(b"4865 6C6c7>",), (None,)], "c binary")
    assert [r[0] and bytes(r[0]) for r in df.select(filters.hex_decode(F.col("c").cast("string"))).collect()] == [b"Hellp", None]
    assert [r[0] for r in df.select(filters.flate_decode("c")).collect()][1] is None
    assert df.select(images.mime_type(F.col("c"))).collect()[1][0] is None


def test_parse_statuses_and_guard(spark):
    docs = _documents(spark, writer.text_pdf("one\ntwo", "Title"), b"This is not a PDF file", None, writer.text_pdf("x" * 5000 + "\n" + "y" * 50))
    rows = {r["doc_id"]: r for r in parse(docs, Options(max_safe_size=1600)).collect()}
    assert rows[0]["text"] == "one\ntwo" and rows[0]["metadata"]["title"] == "Title" and rows[1]["status"] == rows[2]["status"] == "error"
    big = {r["doc_id"]: r for r in parse(docs, Options(max_safe_size=100)).collect()}[0]
    assert big["status"] == "too_large" and big["text"] == TOO_LARGE["buffer"] == big["pages"][0]["text"] and big["metadata"]["page_count"] == 0


def test_streams_of_a_page(spark):
    objects, info = writer.text_objects("x")
    objects[7] = b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R 9 0 R] >>"
    objects[8] = writer.stream(b"BT /F1 10 Tf 1 0 0 1 72 720 Tm <0061> Tj")
    objects[9] = writer.stream(b"0 -20 Td <0062> Tj ET")
    docs = _documents(spark, writer.assemble(objects, info=info))
    assert parse(docs).first()["text"] == "a\nb"
    spaced = text_runs(parse_raw(docs)).orderBy("stream_no").collect()
    assert [(r["stream_no"], r["y"]) for r in spaced] == [(0, 720.0), (1, 700.0)]
    assert [r["y"] for r in text_runs(parse_raw(docs, Options(compat=True))).orderBy("stream_no").collect()] == [720.0, -20.0]


def test_markdown_and_json(spark):
    row = parse(_documents(spark, writer.text_pdf("a \n\nb", "My title", "Me"))).cache()
    assert formats.to_markdown(row).first()["markdown"] == "# My title\n\n## Metadata\n- Author: Me\n- Producer: leafmill\n- Pages: 1\n\n## Page 1\n\na\nb"
    found = json.loads(formats.to_json(row).first()["json"])
    assert found["pages"][0]["page_number"] == 1 and found["metadata"]["author"] == "Me" and found["images"] == []
    plain = formats.to_markdown(parse(_documents(spark, b"no"))).first()["markdown"]
    assert plain == "# Document\n## Metadata\n- Pages: 0"


def test_images_to_files(spark, tmp_path):
    objects, info = writer.text_objects("x")
    objects[2] = objects[2].replace(b"/Font", b"/XObject << /A 20 0 R /B 21 0 R >> /Font")
    objects[20] = writer.stream(bytes(range(12)), b"/Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8")
    objects[21] = writer.stream(b"\xff\xd8\xff\xe0data", b"/Subtype /Image /Width 5 /Height 6", compress=False)
    docs = _documents(spark, writer.assemble(objects, info=info))
    found = extract_images(docs).orderBy("image_no").collect()
    assert [(r["name"], r["mime_type"], r["width"], r["height"]) for r in found] == [("A", "image/png", 2, 2), ("B", "image/jpeg", 5, 6)]
    paths = [r["path"] for r in formats.write_images(extract_images(docs), str(tmp_path)).collect()]
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == ["image_1_p1_2x2.png", "image_2_p1_5x6.jpg"]
    assert extract_images(docs, Options(max_images=1)).count() == 1


def test_files_source_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"d{i}.pdf").write_bytes(writer.text_pdf(f"document {i}"))
    rows = parse_files(spark, str(folder)).collect()
    assert sorted(r["text"] for r in rows) == ["document 0", "document 1", "document 2"]
    query = ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"))
    assert query.awaitTermination(120) and spark.read.parquet(str(tmp_path / "out")).count() == 3
    spark.dataSource.register(PdfDataSource)
    assert sorted(r["text"] for r in spark.read.format("pdf").load(folder.as_uri()).collect()) == ["document 0", "document 1", "document 2"]


def test_length_filter_reaches_the_scan(spark, tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(writer.text_pdf("x"))
    from leafmill.sources.pdf import read_files

    read_files(spark, str(tmp_path)).where("length <= 10").select("doc_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "LessThanOrEqual(length,10)" in plan and "content" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "k long, c binary")
    assert parse_buffers(empty, "k", "c").count() == 0 and extract_images(from_column(empty, "k", "c")).count() == 0


def test_odd_images_and_failed_page_text(spark):
    runs = parse_raw(_documents(spark, writer.text_pdf("a"))).withColumn("pages", F.transform("pages", lambda p: p.withField("failed", F.lit(True))))
    from leafmill.operators.parse import FAILED_PAGE, result

    assert result(runs).first()["text"] == FAILED_PAGE


def test_api_and_preview(spark, tmp_path):
    from leafmill import api
    from leafmill.__main__ import preview

    path = tmp_path / "a.pdf"
    path.write_bytes(writer.text_pdf("hello", "Title"))
    assert api.files_to_markdown(spark, str(tmp_path)).first()["markdown"].startswith("# Title")
    assert json.loads(api.files_to_json(spark, str(tmp_path)).first()["json"])["text"] == "hello"
    df = spark.createDataFrame([(1, path.read_bytes())], "k long, c binary")
    assert api.buffers_to_markdown(df, "k", "c").first()["markdown"].endswith("hello") and json.loads(api.buffers_to_json(df, "k", "c").first()["json"])["text"] == "hello"
    assert api.images_of_files(spark, str(tmp_path)).count() == api.images_of_buffers(df, "k", "c").count() == 0
    assert "1 pages" in preview(str(path)) and "hello" in preview(str(path))


def test_table_functions(spark):
    from leafmill.functions import tables

    tables.register(spark)
    spark.createDataFrame([(1, writer.text_pdf("a\nb"))], "k long, c binary").createOrReplaceTempView("held")
    assert [r["text"] for r in spark.sql("SELECT r.text FROM held, LATERAL pdf_runs(c) r ORDER BY r.seq").collect()] == ["a", "b"]
    assert spark.sql("SELECT o.* FROM held, LATERAL pdf_operations(c) o WHERE operator = 'Tj'").count() == 2
    assert spark.sql("SELECT o.* FROM held, LATERAL pdf_objects(c) o WHERE kind = 'stream'").count() == 2
