"""Affine matrices as columns: arrays of six numbers [a b c d e f]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def multiply(a: Column, b: Column) -> Column:
    """The matrix that applies b, then a."""
    at = lambda m, i: F.get(m, F.lit(i))
    return F.array(
        at(a, 0) * at(b, 0) + at(a, 2) * at(b, 1), at(a, 1) * at(b, 0) + at(a, 3) * at(b, 1), at(a, 0) * at(b, 2) + at(a, 2) * at(b, 3),
        at(a, 1) * at(b, 2) + at(a, 3) * at(b, 3), at(a, 0) * at(b, 4) + at(a, 2) * at(b, 5) + at(a, 4), at(a, 1) * at(b, 4) + at(a, 3) * at(b, 5) + at(a, 5),
    )


def transform(m: Column, x: Column, y: Column) -> Column:
    """The point (x, y) under m."""
    at = lambda i: F.get(m, F.lit(i))
    return F.struct((at(0) * x + at(2) * y + at(4)).alias("x"), (at(1) * x + at(3) * y + at(5)).alias("y"))


def estimated_width(text: Column, size: Column, scale: Column) -> Column:
    """How wide a text is taken to be: 0.55 of the font size a character."""
    return F.length(text) * size * 0.55 * scale / 100
