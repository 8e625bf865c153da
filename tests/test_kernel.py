"""The parsing kernel: filters, values, structure, recovery, fonts, content, images."""

import re
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions.filters import run_length
from leafmill.kernel import filters, fonts, images, writer
from leafmill.kernel.content import Interpreter, operations
from leafmill.kernel.document import inspect, parse
from leafmill.kernel.structure import NotAPdf, Structure
from leafmill.kernel.values import END, Keyword, Name, PdfString, Reader, Ref, text_of


@pytest.mark.parametrize(("data", "expected"), [(b"9jqo^", b"Man "), (b"z", bytes(4)), (b"9jqo", b"Man"), (b"9j\nqo^", b"Man "), (b"<~9jqo^~>", b"Man "), (b"", b"")])
def test_ascii85(data, expected):
    assert filters.decode(data, ["ASCII85Decode"]) == expected


def test_flate_vectors():
    assert filters.decode(zlib.compress(b"Hello World"), ["/FlateDecode"]) == b"Hello World"
    assert filters.decode(zlib.compress(b"Hello World Raw")[2:-4], ["FlateDecode"]) == b"Hello World Raw"
    assert filters.decode(zlib.compress(b"x" * 5000)[:-6], ["Fl"]).startswith(b"x" * 100)
    assert filters.decode(b"plain", ["FlateDecode"]) == b"plain"


def test_hex_run_length_and_unknown():
    assert filters.ascii_hex(b"<48 65 6C6c 7>") == b"Hellp"
    assert filters.run_length(bytes([2, 65, 66, 67, 254, 68, 128, 1])) == b"ABCDDD"
    assert filters.decode(b"abc", ["Nothing", "DCTDecode"]) == b"abc" and filters.decode(b"abc", []) == b"abc"
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


@given(st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_round_trips(data):
    import base64

    assert filters.ascii85(base64.a85encode(data) + b"~>") == data
    assert filters.run_length(run_length(data)) == data
    assert filters.ascii_hex(data.hex().encode() + b">") == data
    assert filters.flate(zlib.compress(data)) == data


@pytest.mark.parametrize("how", [0, 1, 2, 3, 4])
def test_png_predictors(how):
    rows = [bytes([10, 20, 30, 40]), bytes([11, 19, 33, 44])]
    out, last = bytearray(), bytes(4)
    for row in rows:
        out.append(how)
        for i, v in enumerate(row):
            left, up, corner = row[i - 1] if i else 0, last[i], last[i - 1] if i else 0
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda x: (abs(p - x), (left, up, corner).index(x)))
            out.append(v - (0, left, up, (left + up) // 2, paeth)[how] & 0xFF)
        last = row
    assert filters.unpredict(bytes(out), {"Predictor": 12, "Columns": 4}) == b"".join(rows)


def test_values():
    r = Reader(b"[0 0 612 792 612.5 -.5 +3] << /A 1 0 R /B#20C (a\\(b\\)\\101\\n) /C <48656> /D [true null 7 8 R] >> % c\n/N word")
    assert r.value() == [0, 0, 612, 792, 612.5, -0.5, 3]
    assert r.value() == {"A": Ref(1), "B C": PdfString(b"a(b)A\n"), "C": PdfString(b"He`"), "D": [True, None, Ref(7, 8)]}
    assert r.value() == Name("N") and r.value() == Keyword(b"word") and r.value() is END
    assert text_of({"A": [1, 2.5, Name("x"), PdfString(b"(")]}) == "<< /A [1 2.5 /x (\\()] >>"


@given(st.binary(max_size=300))
@settings(max_examples=150, deadline=None)
def test_any_bytes_are_survived(data):
    assert parse(data)["status"] == "error" or data.find(b"%PDF") >= 0
    found = parse(b"%PDF-1.4\n1 0 obj\n" + data)
    assert found["status"] in ("ok", "recovered", "error")
    list(operations(data))


@pytest.mark.parametrize("modern", [False, True])
@pytest.mark.parametrize("damaged", [False, True])
def test_text_round_trip(modern, damaged):
    text = "héllo (x)\nwörld €😀\n" + "\n".join(map(str, range(60)))
    found = parse(writer.text_pdf(text, "T (x)", "Å€", "D:20200102", modern, 40, damaged))
    assert found["status"] == ("recovered" if damaged else "ok") and found["version"] == "1.7"
    assert found["metadata"]["title"] == "T (x)" and found["metadata"]["author"] == "Å€" and found["metadata"]["page_count"] == 2
    assert [r["text"] for p in found["pages"] for s in p["streams"] for r in s] == text.split("\n")
    assert (found["pages"][0]["width"], found["pages"][1]["height"]) == (612, 792)


def test_newline_objects_are_recovered():
    data = b"%PDF-1.4\n1 0\nobj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2\n0 obj\n<< /Type /Pages /Count 1 /Kids [3 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 100] >>\nendobj\ntrailer\n<< /Size 4 /Root 1 0 R >>\nstartxref\n99999\n%%EOF"
    found = parse(data)
    assert found["status"] == "recovered" and len(found["pages"]) == 1 and found["pages"][0]["width"] == 100


def test_not_a_pdf():
    assert parse(b"This is not a PDF file")["status"] == "error" and parse(b"")["status"] == "error"
    with pytest.raises(NotAPdf):
        Structure(b"nothing")


def test_newest_revision_wins():
    objects, info = writer.text_objects("old text")
    data = writer.assemble(objects, info=info)
    previous = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    at = len(data)
    data += b"8 0 obj\n" + writer.stream(b"BT /F1 10 Tf 72 720 Td <006E0065> Tj ET") + b"\nendobj\n"
    table = len(data)
    data += b"xref\n8 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, previous, table)
    assert [r["text"] for r in parse(data)["pages"][0]["streams"][0]] == ["ne"]
    damaged = data.replace(b"startxref\n%d" % table, b"startxref\n99999999")
    assert [r["text"] for r in parse(damaged)["pages"][0]["streams"][0]] == ["ne"]


def test_wrong_length_cycles_and_broken_subsection():
    data = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Count 2 /Kids [3 0 R 2 0 R 3 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /XObject << /F 5 0 R >> >> >>\nendobj\n4 0 obj\n<< /Length 3 >>\nstream\nBT 1 0 0 1 5 5 Tm (abc) Tj ET /F Do\nendstream\nendobj\n5 0 obj\n<< /Subtype /Form /Length 99 >>\nstream\nBT (in) Tj ET /F Do\nendstream\nendobj\nxref\n0 x\ntrailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF"
    found = parse(data)
    texts = [r["text"] for r in found["pages"][0]["streams"][0]]
    assert len(found["pages"]) == 1 and texts[0] == "abc" and 2 <= len(texts) <= 14


def test_max_pages_and_images():
    assert len(parse(writer.text_pdf("\n".join("x" * 1 for _ in range(400))), max_pages=3)["pages"]) == 3
    assert images.mime_type(b"\xff\xd8\xff\xe0") == "image/jpeg" and images.mime_type(b"GIF89a") == "image/gif" and images.mime_type(b"") == images.OCTETS
    made = images.png(2, 1, bytes([1, 2, 3, 4, 5, 6]), 3)
    assert made[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", made[16:24]) == (2, 1)
    assert zlib.decompress(made[made.index(b"IDAT") + 4 : -16]) == b"\0\1\2\3\4\5\6"
    with pytest.raises(ValueError):
        images.png(2, 2, b"123", 1)


@pytest.mark.parametrize(("encoding", "codes", "expected"), [("WinAnsiEncoding", b"\x80", "€"), ("WinAnsiEncoding", b"\x93Hello\x94", "“Hello”"), ("MacRomanEncoding", b"\x80", "Ä"), ("MacRomanEncoding", b"\xa9", "©"), ("WinAnsiEncoding", b"\xa0", " ")])
def test_named_encodings(encoding, codes, expected):
    assert fonts.Font(encoding=encoding).decode(codes) == expected


def test_glyph_names_and_differences():
    assert [fonts.glyph_text(n) for n in ("Adieresis", "space", "uni20AC", "u1F600", "A", "quoteright", "nonsense.alt")] == ["Ä", " ", "€", "😀", "A", "’", ""]
    assert fonts.Font(encoding="WinAnsiEncoding", differences={65: "é"}).decode(b"AB") == "éB"


def test_to_unicode():
    m = fonts.parse_to_unicode(b"2 beginbfchar <01> <0041> <02><D83DDE00> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0078> <0079>] endbfrange")
    assert [m.get(c) for c in (1, 2, 0x10, 0x12, 0x20, 0x21, 0x30)] == ["A", "😀", "a", "c", "x", "y", None]
    late = fonts.parse_to_unicode(b"1 beginbfrange <00> <05> <0041> endbfrange 1 beginbfrange <02> <03> <0061> endbfrange")
    assert [late.get(c) for c in range(6)] == ["A", "B", "a", "b", "E", "F"]


def test_truetype_cmap():
    segments = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HH", 67, 0xFFFF) + b"\0\0" + struct.pack(">HH", 65, 0xFFFF) + struct.pack(">HH", (3 - 65) & 0xFFFF, 1) + struct.pack(">HH", 0, 0)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + segments
    data = b"\0\1\0\0" + struct.pack(">HHHH", 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap
    assert fonts.truetype_glyphs(data) == {3: "A", 4: "B", 5: "C"}
    symbols = data.replace(struct.pack(">HHI", 3, 1, 12), struct.pack(">HHI", 3, 0, 12))
    assert fonts.truetype_glyphs(symbols) == {3: "A", 4: "B", 5: "C"}  # the only table there is
    assert fonts.truetype_glyphs(b"junk") == {}


def test_no_character_map_names_more_codes_than_there_are():
    groups = 50_000
    cmap = struct.pack(">HHHHI", 0, 1, 3, 10, 12) + struct.pack(">HHIII", 12, 0, 16 + 12 * groups, 0, groups) + struct.pack(">III", 0, 0x10FFFF, 1) * groups
    data = b"\0\1\0\0" + struct.pack(">HHHH", 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap
    assert len(fonts.truetype_glyphs(data)) <= 0x110000


def _run(content: bytes, resources: dict | None = None, compat: bool = False):
    s = Structure(writer.text_pdf("x"))
    return Interpreter(s, resources or {}, compat=compat).run(content)


def test_text_operators():
    runs = _run(b"BT /F 10 Tf 2 Tc 1 0 0 1 100 200 Tm (ab) Tj 5 -20 Td (c) Tj 12 TL T* (d) Tj (e) ' 3 1 (f) \" ET")
    assert [(r.text, r.x, r.y) for r in runs] == [("ab", 100, 200), ("c", 105, 180), ("d", 105, 168), ("e", 105, 156), ("f", 105, 144)]
    assert runs[0].width == pytest.approx(2 * 10 * 0.55 + 2) and runs[-1].word_spacing == 3 and runs[-1].char_spacing == 1


def test_arrays_spaces_and_marked_content():
    runs = _run(b"BT 10 Tf /F 10 Tf [(Hel) -100 (lo) -900 (you)] TJ ET /Span << /ActualText (whole) >> BDC BT (part) Tj ET EMC BT (after) Tj ET")
    assert [r.text for r in runs] == ["Hello you", "whole", "after"]


def test_matrices_in_order():
    content = b"q 2 0 0 2 10 10 cm BT /F 10 Tf 2 0 0 2 1 1 Tm 3 4 Td (x) Tj ET Q BT (y) Tj ET"
    runs = _run(content)
    assert (runs[0].x, runs[0].y) == (10 + 2 * (1 + 2 * 3), 10 + 2 * (1 + 2 * 4)) and (runs[1].x, runs[1].y) == (0, 0)
    assert (_run(content, compat=True)[0].x, runs[0].font_size) == (10 + 2 * (1 + 3), 10)


def test_inline_image_is_skipped_as_one_operation():
    found = [o for o, _ in operations(b"q BI /W 1 /H 1 /F /Fl ID \x00EI\xff(Tj EI Q")]
    assert found == ["q", "BI", "Q"]


def test_inspection():
    data = writer.text_pdf("a\nb")
    assert [r["operator"] for r in inspect(data, "operations")] == ["BT", "Tf", "Td", "Tj", "Td", "Tj", "Td", "ET"]
    assert {r["kind"] for r in inspect(data, "objects")} == {"null", "dictionary", "stream"} and inspect(data, "fonts")[0]["has_to_unicode"]
    assert sum(r["in_use"] for r in inspect(data, "xref")) == 8 and inspect(b"no", "xref") == []


# -- malformed structures

_VALUES = [b"3", b"-1", b"5.5", b"/x", b"(s)", b"null", b"true", b"[]", b"[/a /b]", b"[1 -4 2]", b"[99999999999 1 1]", b"<< /A 1 >>", b"1 0 R", b"99 0 R", b"[1 0 R]", b"999999999999", b">>", b"<<", b"[[[["]
_KEYS = [b"W", b"Index", b"Size", b"N", b"First", b"Length", b"Filter", b"DecodeParms", b"Prev", b"XRefStm", b"Root", b"Info", b"Encrypt", b"Pages", b"Kids", b"Count", b"Type", b"MediaBox", b"Resources", b"Font", b"Contents", b"Parent", b"Encoding", b"DescendantFonts", b"ToUnicode", b"XObject", b"Subtype", b"Matrix", b"Differences", b"BaseEncoding", b"Predictor", b"Columns", b"Width", b"ColorSpace"]


@given(st.lists(st.tuples(st.sampled_from(_KEYS), st.sampled_from(_VALUES), st.integers(0, 3)), min_size=1, max_size=4), st.booleans(), st.booleans())
@settings(max_examples=400, deadline=None)
def test_any_dictionary_is_survived(changes, modern, rich):
    """Entries of any kind where others belong: the row has all its fields, and inspections end."""
    from leafmill.kernel import document, writer

    data = writer.operators_pdf("one\ntwo\nthree words here", "t", "again") if rich else writer.text_pdf("one line\nand two", "t", modern=modern)
    for key, value, skip in changes:
        places = [m.start() for m in re.finditer(rb"/%s(?![A-Za-z])" % key, data)]
        if places:
            at = places[skip % len(places)] + len(key) + 1
            data = data[:at] + b" " + value + b" " + data[at:]
    row = document.parse(data)
    assert set(row) == {"version", "status", "error", "metadata", "pages"} and row["status"] in ("ok", "recovered", "truncated", "error")
    for kind in ("xref", "objects", "operations", "fonts"):
        assert isinstance(document.inspect(data, kind), list)


def test_malformed_containers_are_recovered_or_told():
    from leafmill.kernel import document, writer

    for kind in range(len(writer.MALFORMED) + 2):
        row = document.parse(writer.malformed_pdf("one line\ntwo lines", kind))
        texts = [r["text"] for p in row["pages"] for s in p["streams"] for r in s]
        assert texts == ([] if kind in (5, 6, 8) else ["one line", "two lines"])
        assert row["status"] == ("error" if kind == 8 else "ok" if kind in (0, 2) else "recovered")
        assert (kind in (5, 6)) == ("SyntaxTrouble" in (row["error"] or ""))


def test_what_a_limit_cuts_is_told(monkeypatch):
    from leafmill.kernel import document, filters, structure, writer

    data = writer.text_pdf("a line of some length\n" * 5)
    for module in (filters, structure):
        monkeypatch.setattr(module, "MAX_DECODED", 60)
    row = document.parse(data)
    assert row["status"] == "truncated" and "cut at 60 decoded bytes" in row["error"]


def test_forms_that_draw_themselves_end():
    from leafmill.kernel import document, structure, writer

    objects, info = writer.text_objects("x")
    objects[8] = writer.stream(b"BT /F1 10 Tf 72 720 Td <0061> Tj ET " + b"/Fm Do " * 30, b"/Type /XObject /Subtype /Form /Resources << /Font << /F1 3 0 R >> /XObject << /Fm 8 0 R >> >>")
    objects[7] = b"<< /Type /Page /Parent 2 0 R /Contents 9 0 R /Resources << /XObject << /Fm 8 0 R >> >> >>"
    objects[9] = writer.stream(b"/Fm Do")
    with pytest.MonkeyPatch.context() as m:
        for module in (structure, document.Interpreter.__module__):
            m.setattr(f"{module}.MAX_FORMS_DRAWN" if isinstance(module, str) else f"{module.__name__}.MAX_FORMS_DRAWN", 500)
        row = document.parse(writer.assemble(objects, info=info))
    assert row["status"] == "truncated" and "drawings of forms" in row["error"] and sum(len(s) for p in row["pages"] for s in p["streams"]) == 500
