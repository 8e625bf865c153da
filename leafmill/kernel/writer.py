"""A small PDF writer for fixtures: text lines on pages, in a Unicode font, optionally damaged or in newer syntax; and documents
that show each line by another operator, in another kind of font, over several streams and revisions."""

from __future__ import annotations

import re
import zlib

LINES_PER_PAGE = 40
_CMAP = b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap end end"


def escape(text: str) -> bytes:
    """A text string object: Latin-1 as it is, else UTF-16."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        raw = b"\xfe\xff" + text.encode("utf-16-be", "surrogatepass")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def stream(body: bytes, entries: bytes = b"", compress: bool = True) -> bytes:
    if compress:
        body, entries = zlib.compress(body), entries + b" /Filter /FlateDecode"
    return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), b" " + entries if entries else b"", body)


def assemble(objects: dict[int, bytes], root: int = 1, info: int | None = None, modern: bool = False, startxref: int | None = None) -> bytes:
    """A file of numbered objects; modern: dictionaries in an object stream, and a cross-reference stream."""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    packed = [n for n, o in sorted(objects.items()) if modern and b"stream" not in o]
    size = max(objects) + 1
    for n, body in sorted(objects.items()):
        if n not in packed:
            places[n] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    extra = b"/Root %d 0 R" % root + (b" /Info %d 0 R" % info if info else b"")
    if not modern:
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size
        for n in range(1, size):
            out += b"%010d 00000 n \n" % places[n][1] if n in places else b"0000000000 00000 f \n"
        out += b"trailer\n<< /Size %d %s >>\n" % (size, extra)
    else:
        body, head = bytearray(), bytearray()
        for i, n in enumerate(packed):
            head += b"%d %d " % (n, len(body))
            body += objects[n] + b"\n"
            places[n] = (2, size, i)
        places[size] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (size, stream(bytes(head + body), b"/Type /ObjStm /N %d /First %d" % (len(packed), len(head))))
        at = len(out)
        places[size + 1] = (1, at, 0)
        rows = b"".join(bytes([places.get(n, (0, 0, 0))[0]]) + places.get(n, (0, 0, 0))[1].to_bytes(4, "big") + places.get(n, (0, 0, 0))[2].to_bytes(2, "big") for n in range(size + 2))
        out += b"%d 0 obj\n%s\nendobj\n" % (size + 1, stream(rows, b"/Type /XRef /Size %d /W [1 4 2] %s" % (size + 2, extra)))
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % (at if startxref is None else startxref))


def text_objects(text: str, title: str = "", author: str = "", created: str = "", lines_per_page: int = LINES_PER_PAGE) -> tuple[dict[int, bytes], int]:
    """(objects, number of the info dictionary) of a document with the non-empty lines of text."""
    lines = [x for x in text.split("\n") if x]
    pages = [lines[i : i + lines_per_page] for i in range(0, len(lines), lines_per_page)] or [[]]
    objects: dict[int, bytes] = {}
    first = 7
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages)))
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>" % (kids, len(pages))
    objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Fixture /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>"
    objects[4] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Fixture /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>"
    objects[5] = stream(_CMAP)
    objects[6] = b"<< /Title %s /Author %s%s /Producer (leafmill) >>" % (escape(title), escape(author), b" /CreationDate (%s)" % created.encode() if created else b"")
    for i, page in enumerate(pages):
        shown = b"\n".join(b"<%s> Tj 0 -14 Td" % x.encode("utf-16-be", "surrogatepass").hex().encode() for x in page)
        objects[first + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (first + 2 * i + 1)
        objects[first + 2 * i + 1] = stream(b"BT /F1 10 Tf 72 720 Td\n%s\nET" % shown)
    return objects, 6


def text_pdf(text: str, title: str = "", author: str = "", created: str = "", modern: bool = False, lines_per_page: int = LINES_PER_PAGE, damaged: bool = False) -> bytes:
    """A whole fixture; damaged: its startxref points nowhere, so that it must be recovered."""
    objects, info = text_objects(text, title, author, created, lines_per_page)
    return assemble(objects, info=info, modern=modern, startxref=99_999_999 if damaged else None)


#: What a malformed document has in place of a sound dictionary entry: (entry as written, pattern; what replaces it).
MALFORMED = (
    (rb"/W \[1 4 2\]", b"/W 3"), (rb"/Type /XRef", b"/Type /XRef /Index 5"), (rb"/Type /XRef /Size [0-9]+", b"/Type /XRef /Size /x"), (rb"/Type /XRef", b"/Type /XRef /Index [/a /b]"),
    (rb"/N [0-9]+ /First", b"/N /x /First"), (rb"/First [0-9]+", b"/First /y"), (rb"/W \[1 4 2\]", b"/W [1 4 -2]"),
)


def malformed_pdf(text: str, kind: int) -> bytes:
    """A document in the newer syntax with the kind-th of MALFORMED; 0 is sound, and one past the last is no document."""
    if kind > len(MALFORMED):
        return b"no document: " + text.encode("utf-8", "replace")
    data = text_pdf(text, modern=True)
    return re.sub(MALFORMED[kind - 1][0], MALFORMED[kind - 1][1], data) if kind else data


_SIMPLE = re.compile("[\x20-\x7e\xc0-\xff]+")
_DIFFERENCES = {"\xf1": 1, "\xe9": 2, "\xfc": 3, "\xdf": 4}
_GLYPHS = b"/ntilde /eacute /udieresis /germandbls"


def _shown(line: str, i: int) -> tuple[bytes, list[bytes]]:
    """(font, one or two string objects) of a line: in turn a composite font, WinAnsi with differences, MacRoman, where they hold the line."""
    halves = [line[: len(line) // 2], line[len(line) // 2 :]]
    if i % 3 and _SIMPLE.fullmatch(line):
        try:
            if i % 3 == 1:
                return b"/F2", [escape(re.sub("[\xf1\xe9\xfc\xdf]", lambda m: chr(_DIFFERENCES[m.group()]), h)) for h in halves]
            return b"/F3", [escape(h.encode("mac_roman").decode("latin-1")) for h in halves]
        except UnicodeEncodeError:
            pass
    return b"/F1", [b"<" + h.encode("utf-16-be", "surrogatepass").hex().encode() + b">" for h in halves]


def _line(line: str, i: int, y: int) -> tuple[bytes, bytes | None]:
    """(operators that show a line at height y, content of the form that they draw, if any): the i-th way of twelve."""
    font, (one, two) = _shown(line, i)
    whole = one[:-1] + two[1:]
    at, above, f = b"72 %d Td" % y, b"72 %d Td" % (y + 14), font + b" 10 Tf"
    ways = (
        b"BT %s %s %s Tj ET" % (f, at, whole), b"BT %s 14 TL %s %s ' ET" % (f, above, whole), b"BT %s 14 TL %s 0.5 0.1 %s \" ET" % (f, above, whole),
        b"BT %s %s [%s -20 %s] TJ ET" % (f, at, one, two), b"BT %s 1 0 0 1 72 %d Tm %s Tj ET" % (f, y, whole), b"BT %s %s 0 -14 TD %s Tj ET" % (f, above, whole),
        b"BT %s 14 TL %s T* %s Tj ET" % (f, above, whole), b"BT /F1 10 Tf %s /Span << /ActualText <feff%s> >> BDC <00780078> Tj EMC ET" % (at, line.encode("utf-16-be", "surrogatepass").hex().encode()),
        b"BT %s %s /Artifact BMC %s Tj EMC ET" % (f, at, whole), b"q 2 0 0 2 0 0 cm BT %s 5 Tf 36 %.1f Td %s Tj ET Q" % (font, y / 2, whole), b"/Fm%d Do" % y,
        b"BT %s 0.2 Tc 1 Tw 90 Tz 14 TL 1 Tr 2 Ts %s %s Tj 0 Tc 0 Tw 100 Tz 0 Tr 0 Ts ET" % (f, at, whole),
    )
    return ways[i % len(ways)], b"BT %s 0 0 Td %s Tj ET" % (f, whole) if i % len(ways) == 10 else None


def operators_pdf(text: str, title: str, revised: str | None = None, encrypted: bool = False, lines_per_page: int = LINES_PER_PAGE) -> bytes:
    """The non-empty lines of text, shown by all text and graphics operators in turn, two content streams a page; with revised, a second revision gives that title."""
    lines = [x for x in text.split("\n") if x]
    pages = [lines[i : i + lines_per_page] for i in range(0, len(lines), lines_per_page)] or [[]]
    fonts = b"/Font << /F1 3 0 R /F2 8 0 R /F3 9 0 R >>"
    objects, info = text_objects("", title)
    objects = {n: objects[n] for n in (1, 3, 4, 5, 6)}
    objects[8] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Fixture2 /Encoding << /Type /Encoding /BaseEncoding /WinAnsiEncoding /Differences [1 %s] >> >>" % _GLYPHS
    objects[9] = b"<< /Type /Font /Subtype /TrueType /BaseFont /Fixture3 /Encoding /MacRomanEncoding >>"
    objects[10] = b"<< /Filter /Standard /V 1 >>"
    kids, n = [], 11
    for page in pages:
        streams, forms = [[], []], []
        for i, line in enumerate(page):
            y = 720 - 14 * i
            shown, form = _line(line, i, y)
            streams[2 * i >= len(page)].append(shown)
            if form is not None:
                objects[n] = stream(form, b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 72 %d] /Resources << %s >>" % (y, fonts))
                forms.append(b"/Fm%d %d 0 R" % (y, n))
                n += 1
        parts = [b"\n".join(s) for s in streams if s]
        for body in parts:
            objects[n] = stream(body)
            n += 1
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents [%s] /Resources << /XObject << %s >> >> >>" % (b" ".join(b"%d 0 R" % k for k in range(n - len(parts), n)), b" ".join(forms))
        kids.append(b"%d 0 R" % n)
        n += 1
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] /Resources << %s >> >>" % (b" ".join(kids), len(pages), fonts)
    data = assemble(objects, info=info)
    if encrypted:
        data = data.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 10 0 R")
    if revised is not None:
        at, before = len(data), int(data.rsplit(b"startxref\n", 1)[1].split()[0])
        data += b"6 0 obj\n<< /Title %s /Producer (leafmill) >>\nendobj\n" % escape(revised)
        table = len(data)
        data += b"xref\n6 1\n%010d 00000 n \ntrailer\n<< /Size %d /Root 1 0 R /Info 6 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at, n, before, table)
    return data
