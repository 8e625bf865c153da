"""Schemas of the result tables."""

from __future__ import annotations

from pyspark.sql import types as T

_F = T.StructField
_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

RUN = T.StructType([_F("text", _S), _F("x", _D), _F("y", _D), _F("width", _D), _F("font_size", _D), _F("char_spacing", _D), _F("word_spacing", _D)])
IMAGE = T.StructType([_F("name", _S), _F("page_number", _I), _F("x", _D), _F("y", _D), _F("mime_type", _S), _F("width", _I), _F("height", _I), _F("data", T.BinaryType())])
RAW_PAGE = T.StructType([_F("page_number", _I), _F("width", _D), _F("height", _D), _F("failed", _B), _F("streams", T.ArrayType(T.ArrayType(RUN))), _F("images", T.ArrayType(IMAGE))])
RAW_METADATA = T.StructType([
    *(_F(n, _S) for n in ("title", "author", "subject", "keywords", "creator", "producer", "creation_date", "modification_date")), _F("page_count", _I), _F("is_encrypted", _B),
])
PARSED = T.StructType([_F("version", _S), _F("status", _S), _F("error", _S), _F("metadata", RAW_METADATA), _F("pages", T.ArrayType(RAW_PAGE))])

XREF = T.StructType([_F("section", _I), _F("number", _I), _F("generation", _I), _F("offset", _L), _F("in_use", _B), _F("compressed", _B), _F("container", _I)])
OBJECT = T.StructType([_F("number", _I), _F("generation", _I), _F("kind", _S), _F("type", _S), _F("value", _S), _F("stream_length", _L)])
OPERATION = T.StructType([_F("page_number", _I), _F("stream_no", _I), _F("seq", _I), _F("operator", _S), _F("operands", T.ArrayType(_S))])
FONT = T.StructType([
    _F("page_number", _I), _F("key", _S), _F("base_font", _S), _F("subtype", _S), _F("encoding", _S), *(_F(n, _B) for n in ("composite", "symbolic", "embedded", "has_to_unicode")),
])
INSPECTIONS = {"xref": XREF, "objects": OBJECT, "operations": OPERATION, "fonts": FONT}
