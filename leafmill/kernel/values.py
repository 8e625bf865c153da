"""Values of the object syntax, and a reader for them that objects and content streams share.

null, booleans and numbers are Python's own; arrays are lists, dictionaries map bare names to values.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MAX_DEPTH = 50
MAX_ITEMS = 100_000


class Name(str):
    """A name without its slash; #xx is decoded."""

    __slots__ = ()


class PdfString(bytes):
    """The bytes of a literal or hexadecimal string, unescaped."""

    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int = 0


@dataclass
class Stream:
    dictionary: dict
    raw: bytes


class Keyword(bytes):
    """A bare word that is no value: an operator, obj, endobj, R."""

    __slots__ = ()


class SyntaxTrouble(ValueError):
    """Bytes that are no value."""


_TOKEN = re.compile(
    rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)*(?:"
    rb"(?P<number>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z))"
    rb"|/(?P<name>[^\x00\t\n\f\r ()<>\[\]{}/%]*)"
    rb"|(?P<punct><<|>>|[\[\]{}])"
    rb"|<(?P<hex>[^>]*)>?"
    rb"|(?P<paren>\()"
    rb"|(?P<word>[^\x00\t\n\f\r ()<>\[\]{}/%]+)"
    rb"|(?P<stray>[)>]))"
)
_HASH = re.compile(rb"#([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|[\s\S])|\r\n?")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
_REFERENCE = re.compile(rb"[\x00\t\n\f\r ]+([0-9]+)[\x00\t\n\f\r ]+R(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)")
_LOOSE_NUMBER = re.compile(rb"[+-]?[0-9]*\.?[0-9]+")
_PARENS = re.compile(rb"\\[\s\S]|[()]")
END = object()


def _unescape(m: re.Match) -> bytes:
    what = m.group(1)
    if what is None:
        return b"\n"
    if what[:1].isdigit() and what[:1] < b"8":
        return bytes([int(what, 8) & 0xFF])
    return _PLAIN.get(what, what)


def unhex(digits: bytes) -> bytes:
    """Bytes of hexadecimal digits; others are left out, an odd last one is padded with 0."""
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class Reader:
    """Reads values from data at pos. With refs, 'n g R' is a reference."""

    def __init__(self, data: bytes, pos: int = 0, refs: bool = True):
        self.data, self.pos, self.refs = data, pos, refs

    def value(self, depth: int = 0):
        """The next value, a Keyword, a closing bracket as Keyword, or END."""
        m = _TOKEN.match(self.data, self.pos)
        if m is None:
            self.pos = len(self.data)
            return END
        self.pos = m.end()
        kind = m.lastgroup
        if kind == "number":
            return self._number(m.group("number"))
        if kind == "name":
            raw = m.group("name")
            if b"#" in raw:
                raw = _HASH.sub(lambda h: bytes([int(h.group(1), 16)]), raw)
            return Name(raw.decode("latin-1"))
        if kind == "paren":
            return self._literal()
        if kind == "hex":
            return PdfString(unhex(m.group("hex")))
        if kind == "punct":
            if depth > MAX_DEPTH:
                raise SyntaxTrouble("nested too deeply")
            token = m.group("punct")
            if token == b"[":
                return self._array(depth)
            if token == b"<<":
                return self._dictionary(depth)
            return Keyword(token)
        if kind == "word":
            word = m.group("word")
            if word in (b"true", b"false"):
                return word == b"true"
            if word == b"null":
                return None
            if word[:1] in b"+-.0123456789" and (n := _LOOSE_NUMBER.match(word)):
                return float(n.group())
            return Keyword(word)
        return Keyword(m.group("stray"))

    def _number(self, raw: bytes):
        if b"." in raw:
            return float(raw)
        if self.refs and raw[:1] not in b"+-" and (m := _REFERENCE.match(self.data, self.pos)):
            self.pos = m.end()
            return Ref(int(raw), int(m.group(1)))
        return int(raw)

    def _literal(self) -> PdfString:
        depth, begin, at = 1, self.pos, self.pos
        while depth:
            m = _PARENS.search(self.data, at)
            if m is None:
                end = at = len(self.data)
                break
            at = end = m.end()
            depth += {b"(": 1, b")": -1}.get(m.group(), 0)
            end -= 1
        self.pos = at
        raw = self.data[begin:end]
        return PdfString(_ESCAPE.sub(_unescape, raw) if b"\\" in raw or b"\r" in raw else raw)

    def _array(self, depth: int) -> list:
        out: list = []
        while True:
            v = self.value(depth + 1)
            if v is END or v == b"]" and isinstance(v, Keyword):
                return out
            if isinstance(v, Keyword):
                if v in (b"endobj", b"endstream", b">>"):
                    self.pos -= len(v)
                    return out
                continue
            if len(out) < MAX_ITEMS:
                out.append(v)

    def _dictionary(self, depth: int) -> dict:
        out: dict = {}
        while True:
            key = self.value(depth + 1)
            if key is END or key == b">>" and isinstance(key, Keyword):
                return out
            if isinstance(key, Keyword) and key in (b"endobj", b"stream", b"endstream"):
                self.pos -= len(key)
                return out
            if not isinstance(key, Name):
                continue  # resynchronise at the next name
            v = self.value(depth + 1)
            if isinstance(v, Keyword) or v is END:
                if v is not END:
                    self.pos -= len(v)
                out.setdefault(key, None)
                if v is END:
                    return out
                if v not in (b">>", b"endobj", b"stream", b"endstream"):
                    self.pos += len(v)
                continue
            if len(out) < MAX_ITEMS:
                out[key] = v


def text_of(value) -> str:
    """A value in object syntax."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Name):
        return f"/{value}"
    if isinstance(value, PdfString):
        return "(" + value.decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"
    if isinstance(value, Ref):
        return f"{value.number} {value.generation} R"
    if isinstance(value, list):
        return "[" + " ".join(map(text_of, value)) + "]"
    if isinstance(value, dict):
        return "<< " + "".join(f"/{k} {text_of(v)} " for k, v in value.items()) + ">>"
    if isinstance(value, Stream):
        return f"{text_of(value.dictionary)} stream[{len(value.raw)}]"
    return f"{value:g}" if isinstance(value, float) else str(value)


def kind_of(value) -> str:
    """The name of a value's type."""
    for kind, name in ((bool, "boolean"), (Name, "name"), (PdfString, "string"), (Ref, "reference"), (list, "array"), (dict, "dictionary"), (Stream, "stream"), ((int, float), "number")):
        if isinstance(value, kind):
            return name
    return "null"


def decode_text(raw: bytes) -> str:
    """A text string: UTF-16 or UTF-8 by its byte order mark, else PDFDocEncoding's Latin-1 part."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1")
