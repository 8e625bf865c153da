"""Images: what their bytes are, and raw pixels as PNG."""

from __future__ import annotations

import struct
import zlib

from .structure import Structure
from .values import Name, Stream

OCTETS = "application/octet-stream"
# Signatures of image formats.
SIGNATURES = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"\x00\x00\x00\x0cjP  \r\n\x87\n", "image/jp2"))
COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4}


def mime_type(data: bytes) -> str:
    return next((kind for head, kind in SIGNATURES if data.startswith(head)), OCTETS)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width: int, height: int, pixels: bytes, components: int) -> bytes:
    """Eight-bit grey (1), RGB (3) or RGBA (4) pixels as a PNG file."""
    color, step = {1: 0, 3: 2, 4: 6}[components], width * components
    if width < 1 or height < 1 or len(pixels) != step * height:
        raise ValueError("pixels don't fit the size")
    rows = b"".join(b"\0" + pixels[i * step : (i + 1) * step] for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def extract(structure: Structure, stream: Stream) -> dict | None:
    """mime_type, width, height and data of an image object; raw grey and RGB pixels become PNG, CMYK stays raw."""
    d = stream.dictionary
    width, height = structure.resolve(d.get("Width")), structure.resolve(d.get("Height"))
    if not isinstance(width, (int, float)) or not isinstance(height, (int, float)):
        return None
    data = structure.decoded(stream)
    kind = mime_type(data)
    space, bits = structure.resolve(d.get("ColorSpace")), structure.resolve(d.get("BitsPerComponent"))
    if isinstance(space, list) and len(space) > 1 and space[0] == "ICCBased":
        profile = structure.resolve(space[1])
        n = structure.resolve(profile.dictionary.get("N")) if isinstance(profile, Stream) else 0
    else:
        n = COMPONENTS.get(space, 0) if isinstance(space, Name) else 0
    if kind == OCTETS and n in (1, 3) and bits in (None, 8) and len(data) == int(width) * int(height) * n > 0:
        data, kind = png(int(width), int(height), data, n), "image/png"
    return {"mime_type": kind, "width": int(width), "height": int(height), "data": data}
