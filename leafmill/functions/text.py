"""Character maps as columns: code to text by priority, ranges of a CMap, UTF-16 code units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.kernel.fonts import ENCODINGS


def from_code_unit(code: Column) -> Column:
    """The character of a UTF-16 code unit."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def encoding_table(spark: SparkSession) -> DataFrame:
    """(encoding, code, char) of the named encodings; a few hundred rows."""
    rows = [(name, code, char) for name, held in ENCODINGS.items() for code, char in held.items()]
    return spark.createDataFrame(rows, "encoding string, code int, char string")


def decode_codes(codes: DataFrame, encodings: DataFrame, unicode: DataFrame | None = None) -> DataFrame:
    """codes (encoding, code, ...) with text: by the ToUnicode entries (code, str), then the named encoding, then the code itself."""
    out = codes.join(F.broadcast(encodings), ["encoding", "code"], "left")  # the fixed table above
    if unicode is not None:
        out = out.join(unicode.withColumnRenamed("str", "unicode_text"), "code", "left")
    else:
        out = out.withColumn("unicode_text", F.lit(None).cast("string"))
    return out.withColumn("text", F.coalesce("unicode_text", "char", from_code_unit(F.col("code")))).drop("char", "unicode_text")


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """(key..., code, char) of bfrange rows (first, last, target): one per code."""
    return ranges.withColumn("code", F.explode(F.sequence("first", "last"))).withColumn("char", from_code_unit(F.col("target") + F.col("code") - F.col("first"))).drop("first", "last", "target")
