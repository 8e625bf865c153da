"""Packing token sequences: shortest-pack-first over the histogram of piece lengths.

Documents become pieces of at most max_len ids: as many full pieces as fit, and the rest. The
histogram of piece lengths has max_len bins whatever the input, so the packing plan is made on the
driver from the histogram alone: lengths are placed longest first, each into the shortest open
packs that have room, a whole group of equal packs at a time; what finds no room opens new packs.
The plan is a bounded table of rank ranges per length, which is joined back to the pieces by their
rank within their length.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, require, small_batches, staged
from .tokens import encode_slices

#: Rows of one rank bucket, on average, when pieces of a length are counted off.
BUCKET_ROWS = 50_000
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
])

PLAN = ["p_length", "p_from", "p_end", "p_sequence", "p_offset", "pad_to"]


def plan_packs(histogram: dict[int, int], max_len: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of each packing pattern. Shortest-pack-first: of the open packs, those with most room are filled first."""
    open_packs: dict[int, list[tuple[int, list[int]]]] = {}  # room left -> groups of equal packs
    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            room = max((r for r, groups in open_packs.items() if groups), default=-1)
            if room < length:
                open_packs.setdefault(max_len - length, []).append((todo, [length]))
                break
            count, lengths = open_packs[room].pop()
            used = min(todo, count)
            if count > used:
                open_packs[room].append((count - used, lengths))
            open_packs.setdefault(room - length, []).append((used, [*lengths, length]))
            todo -= used
    return [group for room in sorted(open_packs) for group in open_packs[room]]


def plan_rows(patterns: list[tuple[int, list[int]]], max_len: int) -> list[tuple]:
    """Rank ranges: (length, first rank, end rank, first sequence, offset, pad_to) for each place of each pattern."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        total, offset = sum(lengths), 0
        pad_to = total if total & (total - 1) == 0 else max_len
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append((length, rank, rank + count, sequence, offset, pad_to))
            taken[length] = rank + count
            offset += length
        sequence += count
    return rows


def cut_pieces(documents: DataFrame, max_len: int = 1024, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of each document's ids (its end id included)."""

    def pieces(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            where, start, length, crc, total = [], [], [], [], []
            end = end_id.to_bytes(4, "little")
            for i, raw in encode_slices(texts, vocabulary):
                raw += end
                n = len(raw) // 4
                for at in range(0, n, max_len):
                    piece = raw[4 * at : 4 * (at + max_len)]
                    where.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            columns = [ids.take(pa.array(where, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, names=PIECES.names)

    require(documents, "doc_id", "text")
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(pieces, encodes=True), PIECES)


def pack(documents: DataFrame, max_len: int = 1024, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Pack all documents: a row per piece with its sequence_id and offset there, gapless from 0.

    pad_to is the sequence's padded size: max_len, or its own size where that is a power of two.
    Null texts are empty (the end id alone makes a piece). Rows that share a doc_id are packed as
    separate documents; null ids stay null. Ties in a length are ordered by a hash of the piece, then by doc_id and start. An
    empty table gives no rows; other columns of documents are not looked at.
    """
    spark = documents.sparkSession
    small_batches(documents)
    cut = staged(cut_pieces(documents, max_len, end_id, vocabulary), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_len rows at most
    rows = plan_rows(plan_packs(histogram, max_len), max_len)
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("skip"))
    plan = spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(PLAN))], names=PLAN))  # rows of Python would start workers of their own
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_end")))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("p_sequence") + F.col("rank") - F.col("p_from")).alias("sequence_id"), F.col("p_offset").alias("offset"), "pad_to",
    )


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents into sequences of at most 1024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
