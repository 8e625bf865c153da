"""From character codes to text: encodings, glyph names, ToUnicode maps, embedded TrueType maps."""

from __future__ import annotations

import bisect
import functools
import re
import struct
import unicodedata
from dataclasses import dataclass, field

from .values import Keyword, Name, PdfString, Reader, Stream, decode_text

# Glyph names that no rule below gives, with their characters.
GLYPHS = dict(zip(
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash "
    "zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright "
    "asciicircum underscore grave braceleft bar braceright asciitilde quoteleft quoteright quotedblleft quotedblright quotesinglbase "
    "quotedblbase bullet endash emdash ellipsis dagger daggerdbl perthousand guilsinglleft guilsinglright guillemotleft guillemotright "
    "Euro florin trademark copyright registered degree section paragraph periodcentered exclamdown questiondown cent sterling yen currency "
    "brokenbar ordfeminine ordmasculine onesuperior twosuperior threesuperior onequarter onehalf threequarters plusminus multiply divide "
    "logicalnot macron acute cedilla dieresis circumflex tilde mu germandbls AE ae OE oe Oslash oslash Eth eth Thorn thorn Lslash lslash "
    "dotlessi fraction minus fi fl ff ffi ffl nbspace".split(),
    list(" !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~‘’“”‚„•–—…†‡‰‹›«»€ƒ™©®°§¶·¡¿¢£¥¤¦ªº¹²³¼½¾±×÷¬¯´¸¨ˆ˜µßÆæŒœØøÐðÞþŁłı⁄−") + ["fi", "fl", "ff", "ffi", "ffl", "\u00a0"],
))
_ACCENTS = {"acute": "\u0301", "grave": "\u0300", "circumflex": "\u0302", "dieresis": "\u0308", "tilde": "\u0303", "ring": "\u030a", "cedilla": "\u0327", "caron": "\u030c"}
_COMPOSED = re.compile(rf"([A-Za-z])({'|'.join(_ACCENTS)})")
# The standard encoding's characters that aren't ASCII's, from code 0xA1 on ('\0': none).
_STANDARD_HIGH = "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ\0–†‡·\0¶•‚„”»…‰\0¿\0`´ˆ˜¯˘˙¨\0˚¸\0˝˛ˇ—" + "\0" * 16 + "Æ\0ª\0\0\0\0ŁØŒº\0\0\0\0\0æ\0\0\0ı\0\0łøœß"
#: The standard 14 fonts' families; symbolic ones have encodings of their own.
STANDARD_FONTS = tuple(f + s for f in ("Courier", "Helvetica") for s in ("", "-Bold", "-Oblique", "-BoldOblique")) + ("Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Symbol", "ZapfDingbats")


def _codec(name: str, changed: dict[int, str]) -> dict[int, str]:
    out = {}
    for code in range(32, 256):
        try:
            out[code] = bytes([code]).decode(name)
        except UnicodeDecodeError:
            pass
    return out | changed


ENCODINGS: dict[str, dict[int, str]] = {
    "WinAnsiEncoding": _codec("cp1252", {0xA0: " "}),
    "MacRomanEncoding": _codec("mac_roman", {0xCA: " "}),
    "StandardEncoding": {c: chr(c) for c in range(32, 127)} | {0x27: "’", 0x60: "‘"} | {0xA1 + i: c for i, c in enumerate(_STANDARD_HIGH) if c != "\0"},
}


def glyph_text(name: str) -> str:
    """The characters of a glyph name: by table, by accent, by uniXXXX or uXXXXXX; an unknown one gives nothing."""
    base = name.split(".", 1)[0]
    if base in GLYPHS:
        return GLYPHS[base]
    if len(base) == 1:
        return base
    if m := _COMPOSED.fullmatch(base):
        return unicodedata.normalize("NFC", m.group(1) + _ACCENTS[m.group(2)])
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base):
        return bytes.fromhex(m.group(1)).decode("utf-16-be", "replace")
    if (m := re.fullmatch(r"u([0-9A-F]{4,6})", base)) and int(m.group(1), 16) < 0x110000:
        return chr(int(m.group(1), 16))
    return ""


@dataclass
class CodeMap:
    """Codes to text: single ones over ranges whose last character counts up."""

    single: dict[int, str] = field(default_factory=dict)
    ranges: list[tuple[int, int, str]] = field(default_factory=list)

    def get(self, code: int) -> str | None:
        if code in self.single:
            return self.single[code]
        i = bisect.bisect_right(self.ranges, code, key=lambda r: r[0]) - 1
        if i >= 0 and code <= self.ranges[i][1]:
            first, _, text = self.ranges[i]
            return text[:-1] + _chr(ord(text[-1]) + code - first)
        return None

    def __bool__(self) -> bool:
        return bool(self.single or self.ranges)


def _chr(n: int) -> str:
    return chr(n) if n < 0x110000 else "\ufffd"


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "surrogatepass") if len(raw) % 2 == 0 else raw.decode("latin-1")


_SURROGATE = re.compile("[\ud800-\udfff]")


def join_surrogates(text: str) -> str:
    """Pairs of surrogates, perhaps from two codes, as one character."""
    if _SURROGATE.search(text):
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


@functools.lru_cache(maxsize=64)
def parse_to_unicode(data: bytes) -> CodeMap:
    """A ToUnicode map: bfchar and bfrange; later entries win."""
    out, reader, held = CodeMap(), Reader(data, refs=False), []
    ranges: list[tuple[int, int, str]] = []
    while True:
        v = reader.value()
        if not isinstance(v, (Keyword, PdfString, list, int, float, Name, dict, type(None))):
            break
        if not isinstance(v, Keyword):
            held.append(v)
            continue
        if v == b"endbfchar":
            for a, b in zip(held[0::2], held[1::2]):
                if isinstance(a, PdfString):
                    out.single[int.from_bytes(a, "big")] = _utf16(b) if isinstance(b, PdfString) else glyph_text(b) if isinstance(b, Name) else ""
        elif v == b"endbfrange":
            for a, b, c in zip(held[0::3], held[1::3], held[2::3]):
                if not (isinstance(a, PdfString) and isinstance(b, PdfString)):
                    continue
                first, last = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                if isinstance(c, list):
                    for i, x in enumerate(c[: last - first + 1]):
                        out.single[first + i] = _utf16(x) if isinstance(x, PdfString) else ""
                elif isinstance(c, PdfString) and c:
                    for code in [k for k in out.single if first <= k <= last]:
                        del out.single[code]
                    ranges.append((first, last, _utf16(c)))
        held = []
    for i, r in enumerate(ranges):  # a later range covers an earlier one
        if any(s[0] <= r[1] and r[0] <= s[1] for s in ranges[i + 1 :]):
            for code in range(r[0], min(r[1], r[0] + 65535) + 1):
                if not any(s[0] <= code <= s[1] for s in ranges[i + 1 :]):
                    out.single.setdefault(code, r[2][:-1] + _chr(ord(r[2][-1]) + code - r[0]))
        else:
            out.ranges.append(r)
    out.ranges.sort()
    return out


#: Codes that one character map may name: as many as there are characters.
MAX_CODES = 0x110000


def truetype_glyphs(data: bytes) -> dict[int, str]:
    """Glyph index to character, from the best cmap subtable of a TrueType font (formats 4 and 12)."""
    try:
        tables = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">II", data, 20 + 16 * i) for i in range(struct.unpack_from(">H", data, 4)[0])}
        base = tables[b"cmap"][0]
        found = {}
        for i in range(struct.unpack_from(">H", data, base + 2)[0]):
            platform, own, offset = struct.unpack_from(">HHI", data, base + 4 + 8 * i)
            found[platform, own] = base + offset
        order = [(3, 10), (3, 1), *sorted(k for k in found if k[0] == 0), *found]  # else the first one
        at = next(found[k] for k in order if k in found)
        out: dict[int, str] = {}
        kind = struct.unpack_from(">H", data, at)[0]
        if kind == 12:
            left = MAX_CODES
            for i in range(min(struct.unpack_from(">I", data, at + 12)[0], 100_000)):
                first, last, glyph = struct.unpack_from(">III", data, at + 16 + 12 * i)
                last = min(last, 0x10FFFF, first + left - 1)
                left -= max(0, last - first + 1)
                for code in range(first, last + 1):
                    if glyph + code - first:
                        out.setdefault(glyph + code - first, _chr(code))
        elif kind == 4:
            n = struct.unpack_from(">H", data, at + 6)[0] // 2
            ends, starts = struct.unpack_from(f">{n}H", data, at + 14), struct.unpack_from(f">{n}H", data, at + 16 + 2 * n)
            deltas, offsets = struct.unpack_from(f">{n}H", data, at + 16 + 4 * n), struct.unpack_from(f">{n}H", data, at + 16 + 6 * n)
            for i in range(n):
                for code in range(starts[i], ends[i] + 1):
                    if code == 0xFFFF:
                        continue
                    if offsets[i]:
                        place = at + 16 + 6 * n + 2 * i + offsets[i] + 2 * (code - starts[i])
                        glyph = struct.unpack_from(">H", data, place)[0] if place + 2 <= len(data) else 0
                        glyph = (glyph + deltas[i]) & 0xFFFF if glyph else 0
                    else:
                        glyph = (code + deltas[i]) & 0xFFFF
                    if glyph:
                        out.setdefault(glyph, chr(code))
        return out
    except (struct.error, KeyError, StopIteration, IndexError):
        return {}


@dataclass
class Font:
    """What decoding needs of a font, and what inspection shows."""

    name: str = ""
    subtype: str = ""
    encoding: str | None = None
    composite: bool = False
    symbolic: bool = False
    embedded: bool = False
    differences: dict[int, str] = field(default_factory=dict)
    to_unicode: CodeMap = field(default_factory=CodeMap)
    glyphs: dict[int, str] = field(default_factory=dict)
    known: dict[int, str] = field(default_factory=dict)

    def _cid(self, code: int) -> str:
        text = self.to_unicode.get(code)
        self.known[code] = text = text if text is not None else self.glyphs.get(code) or chr(code)
        return text

    def decode(self, raw: bytes) -> str:
        """Text of a shown string."""
        if self.composite:
            known = self.known
            return join_surrogates("".join(known[c] if c in known else self._cid(c) for c in struct.unpack(f">{len(raw) // 2}H", raw[: len(raw) // 2 * 2])))
        named = ENCODINGS.get(self.encoding or "")
        if not (self.to_unicode or self.differences or named):
            return raw.decode("latin-1")
        out = []
        for c in raw:
            t = self.to_unicode.get(c)
            if t is None:
                t = self.differences.get(c)
            if t is None and named:
                t = named.get(c)
            out.append(chr(c) if t is None else t)
        return join_surrogates("".join(out))


def load_font(structure, value) -> Font | None:
    """The font of a font dictionary, or None if it is none."""
    d = structure.resolve(value)
    if not isinstance(d, dict) or not isinstance(subtype := structure.resolve(d.get("Subtype")), Name):
        return None
    font = Font(str(structure.resolve(d.get("BaseFont")) or ""), str(subtype))
    font.composite = subtype == "Type0"
    unicode = structure.resolve(d.get("ToUnicode"))
    if isinstance(unicode, Stream):
        font.to_unicode = parse_to_unicode(structure.decoded(unicode))
    encoding = structure.resolve(d.get("Encoding"))
    if isinstance(encoding, Name):
        font.encoding = str(encoding)
    elif isinstance(encoding, dict):
        base = structure.resolve(encoding.get("BaseEncoding"))
        font.encoding = str(base) if isinstance(base, Name) else None
        code = 0
        for item in structure.resolve(encoding.get("Differences")) or []:
            item = structure.resolve(item)
            if isinstance(item, Name):
                if text := glyph_text(item):
                    font.differences[code] = text
                code += 1
            elif isinstance(item, int):
                code = item
    inner = d
    if font.composite:
        below = structure.resolve(d.get("DescendantFonts"))
        inner = structure.resolve(below[0]) if isinstance(below, list) and below else {}
        inner = inner if isinstance(inner, dict) else {}
    descriptor = structure.resolve(inner.get("FontDescriptor"))
    descriptor = descriptor if isinstance(descriptor, dict) else {}
    flags = structure.resolve(descriptor.get("Flags", d.get("Flags")))
    font.symbolic = isinstance(flags, int) and bool(flags & 4)
    font.embedded = any(k in descriptor for k in ("FontFile", "FontFile2", "FontFile3"))
    if font.composite and not font.to_unicode and structure.resolve(inner.get("Subtype")) == "CIDFontType2":
        file = structure.resolve(descriptor.get("FontFile2"))
        if isinstance(file, Stream) and structure.resolve(inner.get("CIDToGIDMap")) in (None, "Identity"):
            font.glyphs = truetype_glyphs(structure.decoded(file))
    if not font.composite and font.encoding is None and not font.symbolic and not font.embedded:
        font.encoding = "StandardEncoding" if font.differences or font.name in STANDARD_FONTS else None
    return font


__all__ = ["CodeMap", "ENCODINGS", "Font", "decode_text", "glyph_text", "load_font", "parse_to_unicode", "truetype_glyphs"]
