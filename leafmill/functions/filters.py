"""Stream filters as functions over binary columns. Hexadecimal is native; the others run in Arrow batches."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.kernel import filters as kernel


def _binary(name, decode):
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode(bytes(x)) for x in data], dtype=object)

    run.__name__ = name
    return F.pandas_udf(run, T.BinaryType())


flate_decode = _binary("flate_decode", kernel.flate)
ascii85_decode = _binary("ascii85_decode", kernel.ascii85)
run_length_decode = _binary("run_length_decode", kernel.run_length)
lzw_decode = _binary("lzw_decode", kernel.lzw)
flate_encode = _binary("flate_encode", zlib.compress)
ascii85_encode = _binary("ascii85_encode", lambda x: base64.a85encode(x) + b"~>")


def run_length(data: bytes) -> bytes:
    """Run-length data of bytes: runs of two or more, else literals."""
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while n < 128 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[at]])
            at += n
            continue
        begin = at
        while at < len(data) and at - begin < 128 and (at + 1 == len(data) or data[at + 1] != data[at]):
            at += 1
        out += bytes([at - begin - 1]) + data[begin:at]
    return bytes(out + b"\x80")


run_length_encode = _binary("run_length_encode", run_length)


@F.pandas_udf(T.BinaryType())
def decode_stream(data: pd.Series, filters: pd.Series) -> pd.Series:
    """All filters of an array of names, in turn."""
    return pd.Series([None if x is None else kernel.decode(bytes(x), list(f) if f is not None else []) for x, f in zip(data, filters)], dtype=object)


def hex_decode(text: Column) -> Column:
    """ASCIIHex: other characters are left out, an odd last digit is padded on the right. Native."""
    digits = F.regexp_replace(F.split_part(text, F.lit(">"), F.lit(1)), "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def register(spark: SparkSession) -> None:
    """The functions by name, for SQL."""
    for f in (flate_decode, ascii85_decode, run_length_decode, lzw_decode, flate_encode, ascii85_encode, run_length_encode, decode_stream):
        spark.udf.register(f"pdf_{f.func.__name__ if hasattr(f, 'func') else f.__name__}", f)
