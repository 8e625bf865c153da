"""Quality rules: text statistics of every document, and cross-document line frequency by host.

Lines are normalised (ASCII lower case, runs of digits as 0, runs of white space as one space) and
hashed to 64 bits. For each host (the source), distinct documents that hold a line are counted. A
line found in more documents than the host's limit is boilerplate, whatever its length; it is removed from the
host's documents, and a document that is left with too little of its text is rejected.

Documents are distinct by doc_id. With copies_once they are distinct by a hash of the whole text, normalised as lines
are: a stage that is followed by the removal of copies then doesn't reject all of a large group of them.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, require, small_batches, staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is above the limit of a host if more distinct documents hold it than both of these: a number, and a part of the host's rows.
LIMIT_DOCUMENTS = 10
LIMIT_PER_MILLE = 2
#: A document is depleted if its removed lines hold more than this part of its words.
DEPLETED_PERCENT = 70
#: Hot lines up to this many rows (about 100 bytes each in Python) are broadcast; beyond, the join shuffles.
BROADCAST_LINES = 300_000

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))
_DIGITS = re.compile(rb"[0-9]+")


def line_hash(line: bytes) -> int | None:
    """Signed 64-bit hash of a normalised line; None for a line without words."""
    words = line.lower().split()
    if not words:
        return None
    return xxhash.xxh3_64_intdigest(_DIGITS.sub(b"0", b" ".join(words))) - (1 << 63)


def text_hash(text: bytes) -> int:
    """Signed 64-bit hash of a whole text, normalised as lines are."""
    return xxhash.xxh3_64_intdigest(_DIGITS.sub(b"0", b" ".join(text.lower().split()))) - (1 << 63)


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text in UTF-8."""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).translate(None, _CONTINUATION))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    duplicates = len(lines) - len(set(lines))
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(distinct := set(windows)) < len(windows):
            once, again = set(), set()
            for w in windows:
                (again if w in once else once).add(w)
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if w in again:
                    covered[i : i + 3] = b"\x01\x01\x01"
            repeats = sum(covered)
        del distinct
    return n, chars, symbols, duplicates, repeats


STATISTICS = {
    "doc_id": T.LongType(), "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(), "kept": T.BooleanType(), "n_hot_lines": T.LongType(), "n_hot_words": T.LongType(),
}


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def _occurrences(copies_once: bool):
    """A mapInArrow function over (host, doc_id, text): (host, line, document) of each distinct line of a row."""

    def run(batches):
        for batch in batches:
            row, lines, keys = [], [], []
            for i, (doc_id, text) in enumerate(zip(batch.column(1).to_pylist(), _texts(batch))):
                own = {h for x in text.split(b"\n") if (h := line_hash(x)) is not None}
                if own:
                    row += [i] * len(own)
                    lines += own
                    keys += [text_hash(text) if copies_once or doc_id is None else doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(lines, pa.int64()), pa.array(keys, pa.int64())], names=["host", "line", "document"])

    return lean(run)


def hot_lines(documents: DataFrame, host: str = "source", copies_once: bool = False) -> DataFrame:
    """(host, line, n_docs) of the lines above their host's limit, over all documents.

    Rows that share a doc_id are one document; rows with a null one are told apart by their texts.
    """
    held = documents.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    occurrences = held.mapInArrow(_occurrences(copies_once), "host string, line long, document long").distinct()
    counts = occurrences.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > LIMIT_DOCUMENTS)
    sizes = held.groupBy("host").agg(F.count("*").alias("host_docs"))
    return counts.join(sizes, "host").where(F.col("n_docs") * 1000 > F.col("host_docs") * LIMIT_PER_MILLE).select("host", "line", "n_docs")


def assess(documents: DataFrame, host: str = "source", clean: bool = False, copies_once: bool = False) -> DataFrame:
    """Statistics and verdict of each row of documents; with clean, the text without hot lines too.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_hot_lines, n_hot_words; with clean, also row_text (the text without lines above the limit) and
    the other columns of documents under a struct named row. A null text has no words and fails;
    a null host is the host ''. Repeated rows are judged each. An empty table gives no rows.
    """
    require(documents, "doc_id", "text", host)
    small_batches(documents)
    spark = documents.sparkSession
    hot = staged(hot_lines(documents, host, copies_once), "hot-lines")
    n_hot = hot.count()
    at = documents.columns

    if n_hot <= BROADCAST_LINES:
        found: dict[str, set[int]] = {}
        for r in hot.select("host", "line").toLocalIterator():  # BROADCAST_LINES rows at most
            found.setdefault(r["host"], set()).add(r["line"])
        shared = spark.sparkContext.broadcast(found)
        judged = documents.select(
            F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("doc_id").cast("long").alias("doc_id"),
            F.col("text").cast("string").alias("text"), *([F.struct(*(documents[c] for c in at)).alias("row")] if clean else []),
        )
        lookup = lambda batch: [shared.value.get(h, ()) for h in batch.column(0).to_pylist()]
    else:
        # Too many to broadcast: each distinct line of a document meets the hot lines in a shuffled join, and a
        # document gets back the list of its own hot lines, which its text bounds.
        keyed = documents.select(
            F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("doc_id").cast("long").alias("doc_id"),
            F.col("text").cast("string").alias("text"), *([F.struct(*(documents[c] for c in at)).alias("row")] if clean else []),
        )
        sketched = staged(keyed.withColumn("uid", F.expr("uuid()")), "keyed-documents")
        own = sketched.select("host", "text", "uid").mapInArrow(_own_lines, "host string, line long, uid string")
        lists = own.join(hot, ["host", "line"]).groupBy("uid").agg(F.collect_list("line").alias("hot"))
        joined = sketched.join(lists, "uid", "left")
        judged = joined.select("host", "doc_id", "text", *(["row"] if clean else []), F.col("hot").alias("own_hot"))
        lookup = lambda batch: [set(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()]

    @lean
    def verdicts(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            cleaned = []
            for text, above in zip(_texts(batch), lookup(batch)):
                n, chars, symbols, duplicates, repeats = statistics(text)
                hot_n = hot_words = 0
                if above:
                    left = []
                    for line in text.split(b"\n"):
                        if (h := line_hash(line)) is not None and h in above:
                            hot_n += 1
                            hot_words += len(line.split())
                        else:
                            left.append(line)
                    if clean:
                        text = b"\n".join(left)
                failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
                kept = not failed and 100 * hot_words <= DEPLETED_PERCENT * n
                for column, value in zip(columns, (n, chars, symbols, duplicates, repeats, failed, kept, hot_n, hot_words)):
                    column.append(value)
                cleaned.append(text)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
            arrays = [batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            names = list(STATISTICS)
            if clean:
                arrays += [pa.array(cleaned, pa.binary()).cast(pa.string()), batch.column(3)]
                names += ["row_text", "row"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([T.StructField(k, v) for k, v in STATISTICS.items()])
    if clean:
        schema = schema.add("row_text", T.StringType()).add("row", documents.schema)
    return judged.mapInArrow(verdicts, schema)


@lean
def _own_lines(batches):
    for batch in batches:
        row, lines = [], []
        for i, text in enumerate(_texts(batch)):
            own = {h for x in text.split(b"\n") if (h := line_hash(x)) is not None}
            row += [i] * len(own)
            lines += own
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(lines, pa.int64()), batch.column(2).take(take)], names=["host", "line", "uid"])


def filter_documents(documents: DataFrame, host: str = "source", copies_once: bool = False) -> DataFrame:
    """The documents that pass, with lines above the limit removed and n_chars (if there) counted anew."""
    kept = assess(documents, host, clean=True, copies_once=copies_once).where("kept")
    fresh = {"text": F.col("row_text"), "n_chars": F.length("row_text").cast("long")}
    return kept.select(*(fresh.get(c, F.col(f"row.`{c}`")).cast(documents.schema[c].dataType).alias(c) for c in documents.columns))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: statistics and verdict for every document. Nulls, repeated rows and empty tables: as assess()."""
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"'[^\x20\x09-\x0D]+'"

#: The same in DuckDB, by the normalised lines themselves; a null doc_id counts by the text, as in hot_lines().
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT uid, regexp_extract_all(text, {_WORDS}) AS words FROM d),
windows AS (SELECT uid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three FROM (SELECT uid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
again AS (SELECT uid, i FROM windows QUALIFY count(*) OVER (PARTITION BY uid, three) > 1),
repeats AS (SELECT uid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY uid),
lines AS (SELECT uid, doc_id, host, text, line, regexp_extract_all(line, {_WORDS}) AS words FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM d)),
normal AS (SELECT *, regexp_replace(translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS norm FROM lines WHERE len(words) > 0),
hosts AS (SELECT host, count(*) AS size FROM d GROUP BY host),
held AS (SELECT host, norm, count(DISTINCT CASE WHEN doc_id IS NULL THEN 'text ' || md5(text) ELSE CAST(doc_id AS VARCHAR) END) AS n FROM normal GROUP BY host, norm),
hot AS (SELECT host, norm FROM held JOIN hosts USING (host) WHERE n > {LIMIT_DOCUMENTS} AND n * 1000 > size * {LIMIT_PER_MILLE}),
by_line AS (SELECT uid, count(*) - count(DISTINCT line) AS duplicates, count(hot.norm) AS hot_lines, coalesce(sum(CASE WHEN hot.norm IS NOT NULL THEN len(words) END), 0) AS hot_words
  FROM normal LEFT JOIN hot ON hot.host = normal.host AND hot.norm = normal.norm GROUP BY uid),
measured AS (SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(length(array_to_string(w.words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(by_line.duplicates, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(by_line.hot_lines, 0) AS BIGINT) AS n_hot_lines, CAST(coalesce(by_line.hot_words, 0) AS BIGINT) AS n_hot_words
  FROM d JOIN w USING (uid) LEFT JOIN repeats USING (uid) LEFT JOIN by_line USING (uid)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND 100 * n_hot_words <= {DEPLETED_PERCENT} * n_words AS kept FROM judged"""
