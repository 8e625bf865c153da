"""One document's bytes to the rows of the result tables."""

from __future__ import annotations

from dataclasses import asdict

from . import images
from .content import Interpreter, operations
from .fonts import load_font
from .structure import NotAPdf, Structure
from .values import PdfString, Stream, decode_text, kind_of, text_of

#: Info keys with text, and the result's names for them.
INFO = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer"}
#: Notes listed in a document's error.
MAX_NOTES = 20
EMPTY_METADATA = {n: "" for n in INFO.values()} | {"creation_date": None, "modification_date": None, "page_count": 0, "is_encrypted": False}


def metadata(s: Structure) -> dict:
    """Texts of the info dictionary, raw dates, the page tree's count and whether the document is encrypted."""
    info = s.info()
    text = lambda key: decode_text(v) if isinstance(v := s.resolve(info.get(key)), PdfString) else None
    return {n: text(k) or "" for k, n in INFO.items()} | {
        "creation_date": text("CreationDate"), "modification_date": text("ModDate"), "page_count": s.page_count() or 0, "is_encrypted": "Encrypt" in s.trailer,
    }


def contents(s: Structure, page: dict) -> list[bytes]:
    """Decoded content streams of a page, in order."""
    value = s.resolve(page.get("Contents"))
    items = value if isinstance(value, list) else [value]
    return [s.decoded(x) for x in map(s.resolve, items) if isinstance(x, Stream)]


def box(s: Structure, value) -> tuple[float, float]:
    """(width, height) of a media box; 0 where there is none."""
    value = s.resolve(value)
    numbers = [s.resolve(v) for v in value] if isinstance(value, list) else []
    if len(numbers) < 4 or not all(isinstance(v, (int, float)) for v in numbers[:4]):
        return 0.0, 0.0
    return float(numbers[2] - numbers[0]), float(numbers[3] - numbers[1])


def page_images(s: Structure, resources: dict, number: int) -> list[dict]:
    """Images among a page's external objects, used or not."""
    held = s.resolve(resources.get("XObject"))
    out = []
    for name, value in held.items() if isinstance(held, dict) else ():
        o = s.resolve(value)
        if isinstance(o, Stream) and s.resolve(o.dictionary.get("Subtype")) == "Image" and (found := images.extract(s, o)):
            out.append({"name": str(name), "page_number": number, "x": 0.0, "y": 0.0} | found)
    return out


def page_streams(s: Structure, page: dict, resources: dict, compat: bool) -> list[list[dict]]:
    """Runs of each content stream. A page's streams are one program, as its operators may span them; with compat each is its own."""
    fonts: dict = {}
    if compat:
        return [[asdict(r) for r in Interpreter(s, resources, None, 0, True).run(data)] for data in contents(s, page)]
    worker, out = Interpreter(s, resources, fonts), []
    for data in contents(s, page):
        worker.runs = []
        out.append([asdict(r) for r in worker.run(data)])
    return out


def parse(data: bytes, max_pages: int = 100, what: frozenset[str] = frozenset(["text", "images"]), compat: bool = False) -> dict:
    """version, status, error, metadata and pages of a document; never raises, whatever the bytes.

    status: ok; recovered (found by a scan); truncated (a limit of the parser cut something, named in error); error (no
    document, or one that can't be read, with the reason). A page that fails is marked, and the rest goes on; objects that can't
    be read count as missing and are named in error.
    """
    pages: list[dict] = []
    try:
        s = Structure(data)
    except Exception as e:  # noqa: BLE001 one document must not take its task along
        return failure(e)
    try:
        for number, (page, inherited) in enumerate(s.pages(), 1):
            if number > max_pages:
                break
            pages.append(_page(s, page, inherited, number, what, compat))
        if not pages and not s.xref:
            return failure(NotAPdf("no pages and no objects"), s.version)
        held = metadata(s)
    except Exception as e:  # noqa: BLE001
        return failure(e, s.version) | {"pages": pages}
    status = "truncated" if s.cut else "recovered" if s.recovered else "ok"
    return {"version": s.version, "status": status, "error": "; ".join([*s.notes][:MAX_NOTES]) or None, "metadata": held, "pages": pages}


def failure(e: Exception, version: str | None = None) -> dict:
    """The row of a document that can't be read."""
    reason = str(e) if isinstance(e, NotAPdf) else f"{type(e).__name__}: {e}"
    return {"version": version, "status": "error", "error": reason, "metadata": dict(EMPTY_METADATA), "pages": []}


def _page(s: Structure, page: dict, inherited: dict, number: int, what: frozenset[str], compat: bool) -> dict:
    row = {"page_number": number, "width": 0.0, "height": 0.0, "failed": False, "streams": [], "images": []}
    try:
        row["width"], row["height"] = box(s, inherited.get("MediaBox"))
        resources = inherited.get("Resources") or {}
        if "text" in what:
            row["streams"] = page_streams(s, page, resources, compat)
        if "images" in what:
            row["images"] = page_images(s, resources, number)
    except Exception:  # noqa: BLE001 a damaged page must not take the document along
        row |= {"width": 0.0, "height": 0.0, "failed": True, "streams": [], "images": []}
    return row


def inspect(data: bytes, kind: str) -> list[dict]:
    """Rows of an inspection table: xref, objects, operations, fonts; never raises, and a document that can't be read has none."""
    try:
        s = Structure(data)
    except Exception:  # noqa: BLE001
        return []
    out: list[dict] = []
    try:
        _inspect(s, kind, out)
    except Exception:  # noqa: BLE001 the rows so far stay
        pass
    return out


def _inspect(s: Structure, kind: str, out: list[dict]) -> None:
    if kind == "xref":
        out += [
            {"section": section, "number": n, "generation": e.generation if e.container is None else 0, "offset": e.offset, "in_use": e.in_use, "compressed": e.container is not None, "container": e.container}
            for section, n, e in s.sections
        ]
        return
    if kind == "objects":
        for n in sorted(s.xref):
            value = s.get(n)
            d = value.dictionary if isinstance(value, Stream) else value
            type_name = s.resolve(d.get("Type")) if isinstance(d, dict) else None
            out.append({"number": n, "generation": s.xref[n].generation if s.xref[n].container is None else 0, "kind": kind_of(value), "type": str(type_name) if type_name is not None else None, "value": text_of(value), "stream_length": len(value.raw) if isinstance(value, Stream) else None})
        return
    for number, (page, inherited) in enumerate(s.pages(), 1):
        if kind == "operations":
            for stream, data in enumerate(contents(s, page)):
                for seq, (operator, operands) in enumerate(operations(data)):
                    shown = operands if operator != "BI" else operands[:1]
                    out.append({"page_number": number, "stream_no": stream, "seq": seq, "operator": operator, "operands": [text_of(v) for v in shown]})
        elif kind == "fonts":
            held = s.resolve((inherited.get("Resources") or {}).get("Font"))
            for name, value in held.items() if isinstance(held, dict) else ():
                if font := load_font(s, value):
                    out.append({"page_number": number, "key": str(name), "base_font": font.name, "subtype": font.subtype, "encoding": font.encoding, "composite": font.composite, "symbolic": font.symbolic, "embedded": font.embedded, "has_to_unicode": bool(font.to_unicode)})
