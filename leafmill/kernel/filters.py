"""Stream filters: bytes to bytes, tolerant of damage."""

from __future__ import annotations

import re
import zlib

from .values import unhex

#: Abbreviations allowed beside the full names.
SHORT = {"Fl": "FlateDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode", "LZW": "LZWDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
#: Filters whose data is an image format of its own.
PASS = frozenset(["DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode", "Crypt"])
#: Decoded bytes of one stream; more is damage or an attack, and a document cut here says so in its status.
MAX_DECODED = 256 << 20


def flate(data: bytes) -> bytes:
    """zlib, else raw deflate, else raw deflate after a broken two-byte header; what was decoded before damage is kept."""
    best = b""
    for wbits, raw in ((15, data), (-15, data), (-15, data[2:])):
        engine, out = zlib.decompressobj(wbits), bytearray()
        try:
            for i in range(0, len(raw), 1 << 16):
                out += engine.decompress(raw[i : i + (1 << 16)], MAX_DECODED - len(out) + 1)
                if engine.eof or len(out) > MAX_DECODED:
                    return bytes(out[:MAX_DECODED])
        except zlib.error:
            out = _until_damage(raw, wbits)
        if len(out) > len(best):
            best = bytes(out)
    return best or data


def _until_damage(raw: bytes, wbits: int) -> bytearray:
    """What a damaged stream holds before its damage, to a few bytes."""
    engine, out = zlib.decompressobj(wbits), bytearray()
    try:
        for i in range(0, len(raw), 64):
            out += engine.decompress(raw[i : i + 64], MAX_DECODED)
    except zlib.error:
        pass
    return out


def ascii85(data: bytes) -> bytes:
    data = re.sub(rb"[\x00\t\n\f\r ]", b"", data)
    data = data.removeprefix(b"<~").split(b"~", 1)[0]
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _base85(group)
                group = []
    if len(group) > 1:
        out += _base85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _base85(digits: list[int]) -> bytes:
    n = 0
    for d in digits:
        n = n * 85 + d
    return (n & 0xFFFFFFFF).to_bytes(4, "big")


def ascii_hex(data: bytes) -> bytes:
    return unhex(data.lstrip(b"\x00\t\n\f\r <").split(b">", 1)[0])


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    out, table, prefix = bytearray(), [], b""
    width, bits, held = 9, 0, 0
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table = fresh.copy()
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, prefix = fresh.copy(), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif prefix:
            entry = prefix + prefix[:1]
        else:
            break
        out += entry
        if prefix and len(table) < 4096:
            table.append(prefix + entry[:1])
        prefix = entry
        width = max(9, min(12, (len(table) + early).bit_length()))
    return bytes(out)


def unpredict(data: bytes, parameters: dict) -> bytes:
    """Undo the TIFF or PNG predictor that the parameters name."""
    kind = parameters.get("Predictor", 1)
    if not isinstance(kind, int) or kind < 2:
        return data
    colors, depth, columns = (v if isinstance(v := parameters.get(k, d), int) and v > 0 else d for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    step, size = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    out = bytearray()
    if kind == 2:
        if depth != 8:
            return data
        for a in range(0, len(data), size):
            row = bytearray(data[a : a + size])
            for i in range(step, len(row)):
                row[i] = row[i] + row[i - step] & 0xFF
            out += row
        return bytes(out)
    last = bytearray(size)
    for a in range(0, len(data), size + 1):
        how, row = data[a], bytearray(data[a + 1 : a + 1 + size])
        row += bytes(size - len(row))
        for i in range(size):
            left, up, corner = (row[i - step] if i >= step else 0), last[i], (last[i - step] if i >= step else 0)
            if how == 1:
                add = left
            elif how == 2:
                add = up
            elif how == 3:
                add = (left + up) // 2
            elif how == 4:
                p = left + up - corner
                d = (abs(p - left), abs(p - up), abs(p - corner))
                add = (left, up, corner)[d.index(min(d))]
            else:
                add = 0
            row[i] = row[i] + add & 0xFF
        out += row
        last = row
    return bytes(out)


def decode(data: bytes, filters: list[str], parameters: list[dict] | None = None) -> bytes:
    """All filters in turn; none is the identity, and so are unknown ones and image formats."""
    for i, name in enumerate(filters):
        name = SHORT.get(name.removeprefix("/"), name.removeprefix("/"))
        own = parameters[i] if parameters and i < len(parameters) and isinstance(parameters[i], dict) else {}
        if name == "FlateDecode":
            data = unpredict(flate(data), own)
        elif name == "LZWDecode":
            data = unpredict(lzw(data, own.get("EarlyChange", 1)), own)
        elif name == "ASCII85Decode":
            data = ascii85(data)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
    return data
