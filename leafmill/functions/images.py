"""Image bytes as columns: type by signature, and raw pixels as PNG."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.kernel import images as kernel


def mime_type(data: Column) -> Column:
    """The type that the first bytes tell; native."""
    out = F.lit(kernel.OCTETS)
    for head, kind in reversed(kernel.SIGNATURES):
        out = F.when(F.substring(data, 1, len(head)) == F.unhex(F.lit(head.hex())), kind).otherwise(out)
    return F.when(data.isNotNull(), out)


@F.pandas_udf(T.BinaryType())
def encode_png(width: pd.Series, height: pd.Series, pixels: pd.Series, components: pd.Series) -> pd.Series:
    """A PNG file of eight-bit pixels; null where they don't fit the size."""
    out = []
    for w, h, p, c in zip(width, height, pixels, components):
        try:
            out.append(kernel.png(int(w), int(h), bytes(p), int(c)))
        except (ValueError, KeyError, TypeError):
            out.append(None)
    return pd.Series(out, dtype=object)


def png_size(data: Column) -> Column:
    """(width, height) from a PNG's header; native."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    return F.struct(number(17).alias("width"), number(21).alias("height"))
