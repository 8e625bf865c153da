"""Document structure: cross-references in tables and streams, object streams, recovery, the page tree."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .filters import MAX_DECODED, decode
from .values import END, Keyword, Name, Reader, Ref, Stream, SyntaxTrouble

MAX_OBJECT = 10_000_000
MAX_PAGE_DEPTH = 30
MAX_SECTIONS = 1000
MAX_FORM_DEPTH = 12
#: Forms drawn in one document: a form that draws itself some times would else take the time of their power by depth.
MAX_FORMS_DRAWN = 100_000
#: Numbers that one cross-reference stream may name, whatever its dictionary says.
MAX_SIZE = 10_000_000
_VERSION = re.compile(rb"%PDF-([0-9]+\.[0-9]+)")
_STARTXREF = re.compile(rb"startxref[\x00\t\n\f\r ]+([0-9]+)")
_HEADER = re.compile(rb"[\x00\t\n\f\r ]*([0-9]+)[\x00\t\n\f\r ]+([0-9]+)[\x00\t\n\f\r ]+obj(?![A-Za-z])")
_ANY_HEADER = re.compile(rb"(?<![0-9])([0-9]{1,8})[\x00\t\n\f\r ]+([0-9]{1,5})[\x00\t\n\f\r ]+obj(?![A-Za-z])")
_SUBSECTION = re.compile(rb"[\x00\t\n\f\r ]*([0-9]+)[\x00\t\n\f\r ]+([0-9]+)[\x00\t\n\f\r ]*")
_ENTRY = re.compile(rb"[\x00\t\n\f\r ]*([0-9]{1,10})[\x00\t\n\f\r ]+([0-9]{1,5})[\x00\t\n\f\r ]+([nf])")
_STREAM = re.compile(rb"[\x00\t\n\f\r ]*stream(?:\r\n|\n|\r)?")
_ENDSTREAM = re.compile(rb"[\r\n]{0,2}endstream")
# Resource kinds that children merge with those of their ancestors, name by name.
MERGED = ("Font", "XObject", "ExtGState", "ColorSpace", "Pattern", "Shading", "Properties")


class NotAPdf(ValueError):
    """No header, or neither pages nor objects."""


@dataclass(frozen=True)
class Entry:
    """Where an object is: at an offset, or as the index-th of an object stream."""

    section: int
    offset: int
    generation: int
    in_use: bool = True
    container: int | None = None


def version_of(data: bytes) -> str | None:
    m = _VERSION.search(data[:1024])
    return m.group(1).decode() if m else None


def _whole(value) -> bool:
    """A number that can be a count: an integer that isn't negative (nor a boolean)."""
    return type(value) is int and value >= 0


class Structure:
    """Objects of one document by number. Newer sections win; a document that can't be followed is scanned instead."""

    def __init__(self, data: bytes):
        self.data = data
        self.version = version_of(data)
        if self.version is None:
            raise NotAPdf("no %PDF- header")
        self.xref: dict[int, Entry] = {}
        self.sections: list[tuple[int, int, Entry]] = []  # all entries as found: (section, number, entry)
        self.trailer: dict = {}
        self.recovered = False
        self.notes: dict[str, None] = {}  # what was cut or could not be read, in order
        self.cut = False
        self.forms_drawn = 0
        self._cache: dict[int, object] = {}
        self._containers: dict[int, list] = {}
        self._scanned: dict[tuple[int, int], int] | None = None
        try:
            self._follow()
        except Exception:  # noqa: BLE001 whatever a damaged table does, the scan below goes on without it
            self.xref, self.trailer = {}, {}
        if not isinstance(self.resolve(self.trailer.get("Root")), dict) or not self._has_pages():
            self._recover()

    # -- cross-references

    def _follow(self) -> None:
        found = list(_STARTXREF.finditer(self.data, max(0, len(self.data) - 4096)))
        if not found:
            return
        todo, seen, section = [int(found[-1].group(1))], set(), 0
        while todo and section < MAX_SECTIONS:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            part = self._section(at, section)
            for key, value in part.items():
                self.trailer.setdefault(key, value)
            todo = [x for x in (part.get("XRefStm"), part.get("Prev")) if isinstance(x, int)] + todo
            section += 1
        if todo and section >= MAX_SECTIONS:
            self.note(f"cut at {MAX_SECTIONS} cross-reference sections")

    def note(self, what: str) -> None:
        self.notes[what] = None
        self.cut |= what.startswith("cut at")

    def _add(self, section: int, number: int, entry: Entry) -> None:
        self.sections.append((section, number, entry))
        self.xref.setdefault(number, entry)  # sections come newest first

    def _section(self, at: int, section: int) -> dict:
        while self.data[at : at + 1].isspace():
            at += 1
        if self.data[at : at + 4] != b"xref":
            return self._stream_section(at, section)
        at += 4
        while m := _SUBSECTION.match(self.data, at):
            first, count, at = int(m.group(1)), int(m.group(2)), m.end()
            if _HEADER.match(self.data, m.start()) or count > MAX_OBJECT:
                raise SyntaxTrouble("broken subsection")
            for number in range(first, first + count):
                e = _ENTRY.match(self.data, at)
                if e is None:
                    break
                at = e.end()
                self._add(section, number, Entry(section, int(e.group(1)), int(e.group(2)), e.group(3) == b"n" and int(e.group(1)) > 0))
        reader = Reader(self.data, at)
        if reader.value() != b"trailer":
            raise SyntaxTrouble("no trailer")
        trailer = reader.value()
        return trailer if isinstance(trailer, dict) else {}

    def _stream_section(self, at: int, section: int) -> dict:
        found = self._object_at(at)
        if found is None or not isinstance(found[2], Stream):
            raise SyntaxTrouble("no cross-reference stream")
        stream = found[2]
        d = stream.dictionary
        widths, size, index = (self.resolve(d.get(k)) for k in ("W", "Size", "Index"))
        if not isinstance(widths, list) or len(widths) < 3 or not all(_whole(w) and w <= 8 for w in widths):
            raise SyntaxTrouble("no widths")
        if not isinstance(index, list) or not index:
            index = [0, size]
        if not all(_whole(x) and x <= MAX_SIZE for x in index):
            raise SyntaxTrouble("no index")
        rows, at, step = self.decoded(stream), 0, sum(widths)
        for first, count in zip(index[0::2], index[1::2]):
            for number in range(first, first + count):
                if not step or at + step > len(rows):
                    break
                fields, k = [], at
                for w, default in zip(widths, (1, 0, 0)):
                    fields.append(int.from_bytes(rows[k : k + w], "big") if w else default)
                    k += w
                at += step
                kind, a, b = fields
                if kind == 2:
                    self._add(section, number, Entry(section, b, 0, True, a))
                else:
                    self._add(section, number, Entry(section, a, b, kind == 1))
        return d

    def _recover(self) -> None:
        """Scan the bytes for objects: the last definition of a number wins, then what object streams add."""
        self.recovered = True
        self._cache.clear()
        self._containers.clear()
        entries: dict[int, Entry] = {}
        section = 1 + max((s for s, _, _ in self.sections), default=-1)
        for m in _ANY_HEADER.finditer(self.data):
            if (number := int(m.group(1))) <= MAX_OBJECT:
                entries[number] = Entry(section, m.start(), int(m.group(2)))
        self.xref = entries
        for number in list(entries):
            o = self.get(number)
            if isinstance(o, Stream):
                kind = o.dictionary.get("Type")
                if kind == "ObjStm":
                    for i, (inner, _) in enumerate(self._members(number)):
                        entries.setdefault(inner, Entry(section, i, 0, True, number))
                elif kind == "XRef":
                    for k in ("Root", "Info", "Encrypt", "ID"):
                        if k in o.dictionary:
                            self.trailer[k] = o.dictionary[k]
        self.sections += [(section, n, e) for n, e in entries.items()]
        for m in re.finditer(rb"trailer", self.data):
            try:
                t = Reader(self.data, m.end()).value()
            except (SyntaxTrouble, ValueError, RecursionError):
                continue
            if isinstance(t, dict):
                self.trailer |= {k: v for k, v in t.items() if v is not None}
        if not isinstance(self.resolve(self.trailer.get("Root")), dict):
            for number in entries:
                o = self.get(number)
                if isinstance(o, dict) and self.resolve(o.get("Type")) == "Catalog":
                    self.trailer["Root"] = Ref(number)

    # -- objects

    def _object_at(self, at: int) -> tuple[int, int, object] | None:
        m = _HEADER.match(self.data, at)
        if m is None:
            return None
        reader = Reader(self.data, m.end())
        value = reader.value()
        if value is END or isinstance(value, Keyword):
            value = None
        if isinstance(value, dict) and (s := _STREAM.match(self.data, reader.pos)):
            value = Stream(value, self._body(s.end(), value))
        return int(m.group(1)), int(m.group(2)), value

    def _body(self, at: int, d: dict) -> bytes:
        length = d.get("Length")
        if isinstance(length, Ref):
            length = self.resolve(length)
        if isinstance(length, int) and 0 <= length <= len(self.data) - at and _ENDSTREAM.match(self.data, at + length):
            return self.data[at : at + length]
        m = _ENDSTREAM.search(self.data, at)
        end = m.start() if m else self.data.find(b"endobj", at)
        return self.data[at : end if end >= 0 else len(self.data)]

    def get(self, number: int):
        """The object, or None; a reference that leads back to an object being read gives None."""
        if number in self._cache:
            return self._cache[number]
        entry = self.xref.get(number)
        if entry is None or not entry.in_use:
            return None
        self._cache[number] = None
        value = None
        try:
            if entry.container is not None:
                inner = self._contents(entry.container)
                if entry.offset < len(inner) and inner[entry.offset][0] == number:
                    value = inner[entry.offset][1]
                else:
                    value = next((v for n, v in inner if n == number), None)
            else:
                found = self._object_at(entry.offset)
                if found is None or found[0] != number:
                    at = self._headers().get((number, entry.generation))
                    found = self._object_at(at) if at is not None else None
                value = found[2] if found else None
        except Exception as e:  # noqa: BLE001 an object that can't be read is missing; the others are not
            self.note(f"object {number}: {type(e).__name__}")
        self._cache[number] = value
        return value

    def _headers(self) -> dict[tuple[int, int], int]:
        """Where the last object of each number and generation begins, by one scan of the bytes."""
        if self._scanned is None:
            self._scanned = {(int(m.group(1)), int(m.group(2))): m.start() for m in _ANY_HEADER.finditer(self.data)}
        return self._scanned

    def _members(self, container: int) -> list[tuple[int, object]]:
        """What an object stream holds; nothing if it can't be read."""
        try:
            return self._contents(container)
        except Exception as e:  # noqa: BLE001
            self.note(f"object {container}: {type(e).__name__}")
            return []

    def _contents(self, container: int) -> list[tuple[int, object]]:
        if container not in self._containers:
            self._containers[container] = out = []
            stream = self.get(container)
            if isinstance(stream, Stream):
                data = self.decoded(stream)
                n, first = (self.resolve(stream.dictionary.get(k)) for k in ("N", "First"))
                if not _whole(n) or not _whole(first):
                    raise SyntaxTrouble("no counts")
                head = Reader(data[:first], 0, refs=False)
                pairs = []
                for _ in range(min(n, MAX_OBJECT)):
                    number, offset = head.value(), head.value()
                    if not isinstance(number, int) or not isinstance(offset, int):
                        break
                    pairs.append((number, offset))
                for number, offset in pairs:
                    try:
                        value = Reader(data, first + offset).value()
                    except (SyntaxTrouble, ValueError, RecursionError):
                        value = None
                    out.append((number, None if value is END or isinstance(value, Keyword) else value))
        return self._containers[container]

    def resolve(self, value):
        """value itself, or what a reference, perhaps through others, leads to."""
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.number)
        return None

    def decoded(self, stream: Stream) -> bytes:
        """The stream's data after all its filters."""
        d = stream.dictionary
        names, parameters = self.resolve(d.get("Filter", d.get("F"))), self.resolve(d.get("DecodeParms", d.get("DP")))
        names = [names] if isinstance(names, Name) else [self.resolve(n) for n in names] if isinstance(names, list) else []
        parameters = [parameters] if isinstance(parameters, dict) else [self.resolve(p) for p in parameters] if isinstance(parameters, list) else []
        parameters = [{k: self.resolve(v) for k, v in p.items()} if isinstance(p, dict) else {} for p in parameters]
        data = decode(stream.raw, [n for n in names if isinstance(n, Name)], parameters)
        if len(data) >= MAX_DECODED:
            self.note(f"cut at {MAX_DECODED} decoded bytes of a stream")
        return data

    # -- pages

    def info(self) -> dict:
        d = self.resolve(self.trailer.get("Info"))
        return d if isinstance(d, dict) else {}

    def catalog(self) -> dict:
        d = self.resolve(self.trailer.get("Root"))
        return d if isinstance(d, dict) else {}

    def page_count(self) -> int | None:
        """The page tree's own count."""
        tree = self.resolve(self.catalog().get("Pages"))
        count = self.resolve(tree.get("Count")) if isinstance(tree, dict) else None
        return count if isinstance(count, int) else None

    def _has_pages(self) -> bool:
        return next(self.pages(), None) is not None

    def pages(self):
        """(page dictionary, inherited attributes) in order: through the tree, else every page object there is."""
        tree = self.catalog().get("Pages")
        found = False
        for page in self._walk(tree, {}, 0, set()):
            found = True
            yield page
        if not found and self.recovered:
            for number in list(self.xref):
                o = self.get(number)
                if isinstance(o, dict) and self.resolve(o.get("Type")) == "Page":
                    yield o, self._up(o)

    def _walk(self, node, inherited: dict, depth: int, seen: set):
        if isinstance(node, Ref):
            if node.number in seen:
                return
            seen.add(node.number)
        d = self.resolve(node)
        if not isinstance(d, dict):
            return
        if depth > MAX_PAGE_DEPTH:
            self.note(f"cut at {MAX_PAGE_DEPTH} levels of the page tree")
            return
        kids = self.resolve(d.get("Kids"))
        if isinstance(kids, list) and self.resolve(d.get("Type")) != "Page":
            below = self._inherit(inherited, d)
            for kid in kids:
                yield from self._walk(kid, below, depth + 1, seen)
        elif self.resolve(d.get("Type")) == "Page" or "Contents" in d or "MediaBox" in d:
            yield d, self._inherit(inherited, d)

    def _inherit(self, inherited: dict, d: dict) -> dict:
        out = dict(inherited)
        for key in ("MediaBox", "Rotate"):
            if (v := self.resolve(d.get(key))) is not None:
                out[key] = v
        own = self.resolve(d.get("Resources"))
        if isinstance(own, dict):
            out["Resources"] = self.merged(inherited.get("Resources") or {}, own)
        return out

    def _up(self, page: dict) -> dict:
        """Attributes of a page that the tree doesn't lead to, by its parents."""
        chain, node = [], page
        for _ in range(MAX_PAGE_DEPTH):
            chain.append(node)
            node = self.resolve(node.get("Parent"))
            if not isinstance(node, dict) or any(node is c for c in chain):
                break
        out: dict = {}
        for d in reversed(chain):
            out = self._inherit(out, d)
        return out

    def merged(self, above: dict, own: dict) -> dict:
        """Resources of a node: its own entries over those above, by name within the kinds that merge."""
        out = dict(above)
        for kind, value in own.items():
            value = self.resolve(value)
            before = self.resolve(out.get(kind))
            out[kind] = before | value if kind in MERGED and isinstance(before, dict) and isinstance(value, dict) else value
        return out
