"""Queries over the driver's tables, one or more per operator of the engine, and their SQL where SQL can express them.

Documents are fixtures: rows of a table written as PDF bytes, so a query that parses them is a round trip over
synthetic files, and says nothing about the accuracy on files of other origins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import clean, dates, filters, geometry, images, layout, tables
from leafmill.functions import text as codes
from leafmill.operators import formats, relational
from leafmill.operators.fixtures import write_documents, write_malformed, write_operators
from leafmill.operators.parse import Options, extract_images, inspect, parse, parse_raw, result, spread, text_runs
from leafmill.sources.pdf import from_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LINES = 40


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as PDF bytes: title is the source, author the language."""
    return write_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang", lines_per_page=LINES)


_PAGES = f"""WITH l AS (SELECT doc_id, source, lang, [x FOR x IN string_split(text, chr(10)) IF x <> ''] AS lines FROM documents),
    p AS (SELECT doc_id, lines, unnest(range(1, 1 + CAST(greatest(1, ceil(len(lines) / {LINES}.0)) AS BIGINT))) AS n FROM l)"""
_PAGE_TEXT = f"array_to_string(list_slice(lines, (n - 1) * {LINES} + 1, n * {LINES}), chr(10))"


# -- documents: sources, structure, pages, text

@query(f"{_PAGES} SELECT doc_id, CAST(n AS INTEGER) AS page_number, {_PAGE_TEXT} AS text FROM p")
def pdf_roundtrip_text(spark, sf_dir):
    """Flagship: documents to bytes, parsed, laid out within the row, a row per page."""
    pages = result(parse_raw(fixtures(spark, sf_dir), Options(max_pages=tables.ALL_PAGES, what=frozenset(["text"])))).select("doc_id", F.explode("pages").alias("p"))
    return pages.select("doc_id", "p.page_number", "p.text")


@query(f"{_PAGES} SELECT doc_id, string_agg({_PAGE_TEXT}, chr(10) || chr(10) ORDER BY n) AS text, count(*) AS n_pages FROM p GROUP BY doc_id")
def pdf_document_text(spark, sf_dir):
    """Whole documents through the size guard; page texts joined by a blank line."""
    return parse(fixtures(spark, sf_dir), Options(max_pages=tables.ALL_PAGES, what=frozenset(["text"]))).select("doc_id", "text", F.size("pages").cast("long").alias("n_pages"))


@query(f"{_PAGES} SELECT doc_id, CAST(n AS INTEGER) AS page_number, {_PAGE_TEXT} AS text FROM p WHERE len(lines) > 0")
def pdf_roundtrip_window(spark, sf_dir):
    """The same texts by the relational form: a row per run, lag window, ordered aggregation."""
    runs = text_runs(parse_raw(fixtures(spark, sf_dir), Options(max_pages=tables.ALL_PAGES, what=frozenset(["text"]))))
    streams = layout.layout_table(runs, ["doc_id", "page_number", "stream_no"])
    return streams.groupBy("doc_id", "page_number").agg(F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY stream_no)").alias("text"))


@query(f"{_PAGES} SELECT doc_id, CAST(max(n) AS INTEGER) AS page_count, CASE WHEN doc_id % 7 = 0 THEN 'recovered' ELSE 'ok' END AS status, '1.7' AS version FROM p GROUP BY doc_id")
def pdf_page_counts(spark, sf_dir):
    """Tables, streams and damage: the page tree's count, and how each document was read."""
    return parse_raw(fixtures(spark, sf_dir), Options(what=frozenset())).select("doc_id", "metadata.page_count", "status", "version")


@query(f"{_PAGES} SELECT doc_id, CAST(n AS INTEGER) AS page_number, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height FROM p WHERE n <= 2")
def pdf_page_boxes(spark, sf_dir):
    """The first two pages' inherited boxes: the page limit reaches the kernel."""
    pages = parse_raw(fixtures(spark, sf_dir), Options(max_pages=2, what=frozenset())).select("doc_id", F.explode("pages").alias("p"))
    return pages.select("doc_id", "p.page_number", "p.width", "p.height")


@query("""SELECT o_orderkey AS doc_id, o_orderpriority AS title, o_orderstatus AS author, 'leafmill' AS producer, date_trunc('second', o_orderdate) AS creation_date, false AS is_encrypted FROM orders""")
def pdf_metadata(spark, sf_dir):
    """Info dictionaries: orders as titled, dated documents."""
    orders = table(spark, sf_dir, "orders").withColumn("created", F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+02'00'")))
    written = write_documents(orders, "o_orderkey", "o_orderpriority", "o_orderpriority", "o_orderstatus", "created")
    m = F.col("metadata")
    return result(parse_raw(written, Options(what=frozenset()))).select("doc_id", m["title"].alias("title"), m["author"].alias("author"), m["producer"].alias("producer"), m["creation_date"].alias("creation_date"), m["is_encrypted"].alias("is_encrypted"))


@query("""SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'too_large' WHEN doc_id % 3 = 0 THEN 'error' END AS status FROM documents WHERE length(text) > 2000 OR doc_id % 3 = 0""")
def pdf_guards(spark, sf_dir):
    """The size guard, by the length that a scan can filter on, and contents that are no PDF."""
    docs = table(spark, sf_dir, "documents")
    written = docs.select("doc_id", F.length("text").cast("long").alias("length"), F.when(F.col("doc_id") % 3 == 0, F.lit("This is not a PDF file")).otherwise("%PDF-1.4\n1 0 obj\n<< >>\nendobj\n").cast("binary").alias("content"))
    return parse(written, Options(max_safe_size=2000)).where("status in ('too_large', 'error')").select("doc_id", "status")


@query(f"{_PAGES} SELECT doc_id, CAST(n AS INTEGER) AS page_number, 612.0::DOUBLE AS width, CAST(len(list_slice(lines, (n - 1) * {LINES} + 1, n * {LINES})) AS INTEGER) AS n_runs FROM p")
def pdf_sql_pages(spark, sf_dir):
    """Pages by a table function in SQL, one lateral join."""
    tables.register(spark)
    fixtures(spark, sf_dir).createOrReplaceTempView("_pdf_fixtures")
    return spark.sql("SELECT d.doc_id, p.page_number, p.width, p.n_runs FROM _pdf_fixtures d, LATERAL pdf_pages(d.content) p")


@query(f"""{_PAGES} SELECT doc_id, CAST(n AS INTEGER) AS page_number, {_PAGE_TEXT} AS text,
    source || CASE WHEN doc_id % 5 = 0 THEN ' revised' ELSE '' END AS title, doc_id % 11 = 0 AS is_encrypted FROM p JOIN (SELECT doc_id, source FROM l) USING (doc_id)""")
def pdf_operators(spark, sf_dir):
    """Lines shown by each text and graphics operator in turn, through composite and simple fonts, forms, two streams a page, two revisions; the newest title counts."""
    written = write_operators(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    found = result(parse_raw(written, Options(max_pages=tables.ALL_PAGES, what=frozenset(["text"])))).select("doc_id", F.explode("pages").alias("p"), "metadata")
    return found.select("doc_id", "p.page_number", "p.text", "metadata.title", "metadata.is_encrypted")


@query(f"""{_PAGES} SELECT doc_id, CASE WHEN doc_id % 9 IN (0, 2) THEN 'ok' WHEN doc_id % 9 = 8 THEN 'error' ELSE 'recovered' END AS status,
    CASE WHEN doc_id % 9 < 5 OR doc_id % 9 = 7 THEN string_agg({_PAGE_TEXT}, chr(10) || chr(10) ORDER BY n) ELSE '' END AS text, CASE WHEN doc_id % 9 < 5 OR doc_id % 9 = 7 THEN count(*) ELSE 0 END AS n_pages FROM p GROUP BY doc_id""")
def pdf_damaged(spark, sf_dir):
    """Sound documents among malformed ones: broken cross-reference streams are recovered, unreadable object streams leave no page, none fails the job."""
    written = write_malformed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return parse(written, Options(max_pages=tables.ALL_PAGES, what=frozenset(["text"]))).select("doc_id", "status", "text", F.size("pages").cast("long").alias("n_pages"))


# -- inspection

@query(f"{_PAGES} SELECT doc_id, CAST(n AS INTEGER) AS page_number, operator, CASE operator WHEN 'Tj' THEN k WHEN 'Td' THEN k + 1 ELSE 1 END AS n_operations FROM (SELECT doc_id, n, len(list_slice(lines, (n - 1) * {LINES} + 1, n * {LINES})) AS k FROM p), (SELECT unnest(['BT', 'ET', 'Tf', 'Td', 'Tj']) AS operator) WHERE operator <> 'Tj' OR k > 0")
def pdf_operation_histogram(spark, sf_dir):
    """Content operations, counted by page and operator."""
    return inspect(fixtures(spark, sf_dir), "operations").groupBy("doc_id", "page_number", "operator").agg(F.count("*").alias("n_operations"))


@query(f"{_PAGES} SELECT doc_id, kind, CAST(CASE kind WHEN 'dictionary' THEN 5 + n WHEN 'stream' THEN 1 + n END AS BIGINT) AS n_objects FROM (SELECT doc_id, max(n) AS n FROM p GROUP BY doc_id), (SELECT unnest(['dictionary', 'stream']) AS kind)")
def pdf_object_kinds(spark, sf_dir):
    """Objects by kind, but for the containers of the newer syntax."""
    rows = inspect(fixtures(spark, sf_dir), "objects").where("kind <> 'null' and (type is null or type not in ('ObjStm', 'XRef'))")
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n_objects"))


@query(f"{_PAGES} SELECT doc_id, CAST(6 + 2 * max(n) + CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 0 END AS BIGINT) AS n_in_use FROM p GROUP BY doc_id")
def pdf_xref_entries(spark, sf_dir):
    """Entries in use of every document: tables, streams (which list two containers more) and recovered files."""
    return inspect(fixtures(spark, sf_dir), "xref").where("in_use").groupBy("doc_id").agg(F.count("*").alias("n_in_use"))


@query(f"{_PAGES} SELECT doc_id, CAST(n AS INTEGER) AS page_number, 'F1' AS key, 'Type0' AS subtype, 'Identity-H' AS encoding, true AS composite, true AS has_to_unicode FROM p")
def pdf_fonts(spark, sf_dir):
    """Fonts that pages inherit."""
    return inspect(fixtures(spark, sf_dir), "fonts").select("doc_id", "page_number", "key", "subtype", "encoding", "composite", "has_to_unicode")


# -- layout

def _event_runs(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), e.alias("seq"), F.when(e % 3 == 0, F.substring("event_type", 1, 1)).otherwise(F.col("event_type")).alias("text"),
        ((e * 37) % 400).cast("double").alias("x"), (F.floor(e / 50) * 3).cast("double").alias("y"), F.when(e % 11 != 0, (e % 30).cast("double")).alias("width"),
        F.when(e % 7 == 0, 0.0).when(e % 13 != 0, (8 + e % 6).cast("double")).alias("font_size"), (e % 2).cast("double").alias("char_spacing"), (e % 5).cast("double").alias("word_spacing"),
    )


_LAYOUT_SQL = """WITH r AS (
      SELECT user_id AS doc_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN substring(event_type, 1, 1) ELSE event_type END AS text, CAST((event_id * 37) % 400 AS DOUBLE) AS x,
             CAST(floor(event_id / 50) * 3 AS DOUBLE) AS y, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 30 AS DOUBLE) ELSE 5.0 * length(CASE WHEN event_id % 3 = 0 THEN substring(event_type, 1, 1) ELSE event_type END) END AS width,
             CASE WHEN event_id % 7 = 0 OR event_id % 13 = 0 THEN 12.0 ELSE CAST(8 + event_id % 6 AS DOUBLE) END AS fs, CAST(event_id % 2 AS DOUBLE) AS tc, CAST(event_id % 5 AS DOUBLE) AS tw FROM events),
    b AS (SELECT *, lag(text) OVER w AS bt, lag(x + width) OVER w AS bend, lag(y) OVER w AS by_ FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
    s AS (SELECT *, CASE WHEN bt IS NULL THEN '' WHEN abs(y - by_) > 5 THEN chr(10) WHEN bend > 0 AND (CASE
        WHEN length(text) = 1 AND length(bt) = 1 THEN NOT (x - bend < fs * 0.5) AND x - bend > greatest(tw * 0.8, fs * 0.7, tc * 6, fs * 0.4)
        WHEN length(text) = 1 OR length(bt) = 1 THEN NOT (x - bend < fs * 0.5) AND x - bend > greatest(tw * 0.8, fs * 0.6, tc * 5)
        ELSE x - bend > greatest(tc * 1.2, tw * 0.5, fs * 0.2) END) THEN ' ' ELSE '' END AS sep FROM b)
    SELECT doc_id, string_agg(sep || text, '' ORDER BY seq) AS text FROM s GROUP BY doc_id"""


@query(_LAYOUT_SQL)
def gap_layout_window(spark, sf_dir):
    """Layout as a lag window and an ordered aggregation, over events as runs."""
    return layout.layout_table(_event_runs(spark, sf_dir), ["doc_id"])


@query(_LAYOUT_SQL)
def gap_layout_hof(spark, sf_dir):
    """The same layout within the row, over arrays of runs."""
    names = ("text", "x", "y", "width", "font_size", "char_spacing", "word_spacing")
    runs = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*names).alias("run")))), lambda r: r["run"])
    return _event_runs(spark, sf_dir).groupBy("doc_id").agg(runs.alias("runs")).select("doc_id", layout.layout_runs(F.col("runs")).alias("text"))


# -- clean-up

_L = "[a-zA-ZäöåÄÖÅ]"


@query(f"SELECT doc_id, regexp_replace(text, '({_L}{{2,}}) ({_L})({_L}{{2,}})', '\\1\\2\\3', 'g') AS text FROM documents")
def clean_fuse(spark, sf_dir):
    """Adjacent words of two and three letters or more become one; nulls stay null."""
    return table(spark, sf_dir, "documents").select("doc_id", clean.fuse(F.col("text")).alias("text"))


def _split_sql(out: str) -> str:
    for first, second in clean.APART:
        out = f"regexp_replace({out}, '({first})({second})', '{first if first == 'uppdatera' else chr(92) + '1'} \\2', 'gi')"
    return out


_PHRASES = " ".join(f"{a} {b.split('|')[0]}" for a, b in clean.APART)


_UNSPACED = "replace(text, ' ', '')"


@query(f"SELECT doc_id, {_split_sql(_UNSPACED)} AS text FROM (SELECT doc_id, substring('{_PHRASES}', 1 + CAST(doc_id % 40 AS INTEGER), 60 + CAST(doc_id % 100 AS INTEGER)) AS text FROM documents)")
def clean_split(spark, sf_dir):
    """The words that belong apart, in texts where they were fused."""
    n = F.col("doc_id") % 40
    fused = F.replace(F.substring(F.lit(_PHRASES), n.cast("int") + 1, (60 + F.col("doc_id") % 100).cast("int")), F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", clean.split_words(fused).alias("text"))


@query("SELECT doc_id, replace(replace(text || ' Företagsnamnetsregistreringsdatum', 'Företagsnamnetsregistreringsdatum', 'Företagsnamnets registreringsdatum'), 'Objektetsregis treringsdatum', 'Objektets registreringsdatum') AS text FROM documents")
def clean_repair(spark, sf_dir):
    """Literal repairs; nulls stay null."""
    return table(spark, sf_dir, "documents").select("doc_id", clean.repair(F.concat("text", F.lit(" Företagsnamnetsregistreringsdatum"))).alias("text"))


def _merge_sql(text: str) -> str:
    """merge_letter without a back-reference: a branch for each letter that the first word may end with."""
    ended = "|".join(f"{clean.L}+{c} {c} {clean.L}{{2,}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZäöåÄÖÅ")
    return f"regexp_replace({text}, '({ended})|({clean.L}{{2,}}) ({clean.L}) ({clean.L}{{2,}})', '\\1\\2\\3\\4', 'g')"


def _swedish_sql(text: str) -> str:
    """All repairs in order; the letter that must not follow a long run is a character that is kept."""
    out = f"regexp_replace({_merge_sql(text)}, '({clean.L}{{2,}}) ({clean.L})({clean.L}{{2,}})', '\\1\\2\\3', 'g')"
    for wrong, right in clean.REPAIRS:
        out = f"replace({out}, '{wrong}', '{right}')"
    return f"regexp_replace({_split_sql(out)}, '({clean.L}{{9,}}(?:ets|ens|ats))({clean.L}{{8}})($|[^{clean.L[1:]})', '\\1 \\2\\3', 'g')"


@query(f"SELECT doc_id, {_merge_sql('text')} AS text FROM documents")
def clean_merge_letter(spark, sf_dir):
    """A letter between two words joins them, unless the first ends with it; nulls stay null."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", clean.merge_letter(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_swedish_sql('text')} AS text FROM documents")
def clean_swedish(spark, sf_dir):
    """All repairs in order; nulls stay null."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", clean.swedish(F.col("text")).alias("text"))


# -- filters

def _roundtrip(name: str, encode, decode, source: str = "documents", key: str = "doc_id", text: str = "text"):
    def run(spark, sf_dir):
        data = F.col(text).cast("binary")
        return table(spark, sf_dir, source).select(F.col(key), decode(encode(data)).cast("string").alias("text"))

    run.__name__ = name
    query(f"SELECT {key}, {text} AS text FROM {source}")(run)


_roundtrip("filter_flate", filters.flate_encode, filters.flate_decode, "pages", "page_id", "html")
_roundtrip("filter_ascii85", filters.ascii85_encode, filters.ascii85_decode)
_roundtrip("filter_run_length", filters.run_length_encode, filters.run_length_decode)
_roundtrip("filter_hex", lambda x: F.concat(F.lit("<"), F.hex(x), F.lit(">")), filters.hex_decode)
_roundtrip("filter_chain", lambda x: filters.ascii85_encode(filters.flate_encode(x)), lambda x: filters.decode_stream(x, F.array(F.lit("ASCII85Decode"), F.lit("FlateDecode"))))


# -- images

@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/jp2' ELSE 'application/octet-stream' END AS mime_type FROM pages""")
def mime_sniff(spark, sf_dir):
    """Types of images by their first bytes; an empty or null content is an octet stream."""
    from leafmill.kernel.images import SIGNATURES

    heads = F.array(*(F.unhex(F.lit(h.hex())) for h, _ in SIGNATURES), F.lit(b""))
    data = F.concat(F.get(heads, (F.col("page_id") % 6).cast("int")), F.col("html").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", images.mime_type(data).alias("mime_type"))


@query("SELECT p_partkey, p_size AS width, CAST(1 + p_partkey % 4 AS INTEGER) AS height, 'image/png' AS mime_type FROM part")
def raw_png_wrap(spark, sf_dir):
    """Raw RGB pixels as PNG files, and what their headers say."""
    height = (F.col("p_partkey") % 4 + 1).cast("int")
    pixels = F.unhex(F.expr("repeat('A0B0C0', p_size * cast(1 + p_partkey % 4 as int))"))
    made = table(spark, sf_dir, "part").select("p_partkey", images.encode_png(F.col("p_size"), height, pixels, F.lit(3)).alias("data"))
    return made.select("p_partkey", images.png_size(F.col("data"))["width"].alias("width"), images.png_size(F.col("data"))["height"].alias("height"), images.mime_type(F.col("data")).alias("mime_type"))


_IMAGE_PDF = "%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Count 1 /Kids [3 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 100] /Resources << /XObject << "


@query("""SELECT p_partkey AS doc_id, CAST(i AS INTEGER) AS image_no, 'I' || i AS name, 1 AS page_number, p_size AS width, 'image/png' AS mime_type, 'image_' || (i + 1) || '_p1_' || p_size || 'x1.png' AS file_name
    FROM (SELECT p_partkey, p_size, unnest(range(least(2, 1 + p_partkey % 3))) AS i FROM part)""")
def pdf_images(spark, sf_dir):
    """Images of a page's resources, used or not, with a limit of two a document, as PNG."""
    parts = table(spark, sf_dir, "part").withColumn("n", (F.col("p_partkey") % 3).cast("int"))
    numbers = F.sequence(F.lit(0), F.col("n"))
    names = F.array_join(F.transform(numbers, lambda i: F.concat(F.lit("/I"), i, F.lit(" "), i + 10, F.lit(" 0 R"))), " ")
    body = F.concat(F.lit("\nstream\n"), F.expr("repeat('rgb', p_size)"), F.lit("\nendstream\nendobj\n"))
    head = lambda i: F.concat(i + 10, F.lit(" 0 obj\n<< /Subtype /Image /ColorSpace /DeviceRGB /BitsPerComponent 8 /Height 1 /Width "), F.col("p_size"), F.lit(" /Length "), F.col("p_size") * 3, F.lit(" >>"))
    objects = F.array_join(F.transform(numbers, lambda i: F.concat(head(i), body)), "")
    data = F.concat(F.lit(_IMAGE_PDF), names, F.lit(" >> >> >>\nendobj\n"), objects, F.lit("trailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF")).cast("binary")
    found = formats.image_names(extract_images(from_column(parts.withColumn("data", data), "p_partkey", "data"), Options(max_images=2)))
    return found.select("doc_id", "image_no", "name", "page_number", "width", "mime_type", "file_name")


# -- dates

@query("SELECT o_orderkey, date_trunc('second', o_orderdate) AS parsed FROM orders")
def pdf_date(spark, sf_dir):
    """Dates as the info dictionary has them; null stays null."""
    text = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("Z"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))).select("o_orderkey", dates.pdf_date(F.col("text")).alias("parsed"))


@query("""SELECT o_orderkey, make_timestamp(1990 + o_orderkey % 30, 1, 1, 0, 0, 0.0) + to_months(CAST(coalesce(nullif(o_orderkey % 60, 0), 1) - 1 AS INTEGER))
    + to_days(CAST(coalesce(nullif(o_custkey % 90, 0), 1) - 1 AS INTEGER)) + to_hours(CAST(o_orderkey % 50 AS INTEGER)) AS parsed FROM orders""")
def date_rollover(spark, sf_dir):
    """Months, days and hours out of range."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("D:"), (1990 + k % 30).cast("string"), two(k % 60), two(F.col("o_custkey") % 90), two(k % 50))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))).select("o_orderkey", dates.pdf_date(F.col("text")).alias("parsed"))


# -- limits, joins of texts, formats

@query("SELECT user_id, event_id, CAST(place AS INTEGER) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events) WHERE place <= 10")
def page_limit(spark, sf_dir):
    """Each document's first ten pages; ties don't occur, as event ids are unique."""
    return relational.first_per_document(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"], 10)


@query("SELECT user_id, string_agg(event_id, ',' ORDER BY event_id) AS images FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 5 GROUP BY user_id")
def image_cap(spark, sf_dir):
    """The cap within the row: arrays flattened and cut."""
    pages = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 100).alias("page")).agg(F.array_sort(F.collect_list("event_id")).alias("images"))
    rows = pages.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("page", "images"))).alias("pages"))
    capped = F.slice(F.flatten(F.transform("pages", lambda p: p["images"])), 1, 5)
    return rows.select("user_id", F.array_join(capped.cast("array<string>"), ",").alias("images"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def document_join_text(spark, sf_dir):
    """Page texts of a document in order, joined by a blank line; null texts are left out."""
    return relational.join_texts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def _conversation_results(spark, sf_dir) -> DataFrame:
    page = F.struct(F.col("turn").cast("int").alias("page_number"), F.col("text").alias("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    image = F.struct(F.lit(1).alias("page_number"), F.lit(2).alias("width"), F.lit(3).alias("height"), F.lit("image/png").alias("mime_type"))
    number = F.when(F.col("conv_id") % 4 == 0, F.array_repeat(image, (F.col("conv_id") % 30).cast("int"))).otherwise(F.array_repeat(image, 0))
    title = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))).otherwise("")
    metadata = F.struct(title.alias("title"), F.lit("someone").alias("author"), F.lit("").alias("producer"), F.lit("").alias("creator"), F.size("pages").alias("page_count"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("text"), "pages", number.alias("images"), metadata.alias("metadata"))


@query("""WITH c AS (SELECT conv_id AS doc_id, count(*) AS n, string_agg(chr(10) || '## Page ' || turn || chr(10) || chr(10) || regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(?m)[\\t ]+$', '', 'g'), chr(10) ORDER BY turn) AS body,
      CASE WHEN conv_id % 4 = 0 THEN CAST(conv_id % 30 AS INTEGER) ELSE 0 END AS k FROM conversations GROUP BY conv_id)
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# Conversation ' || doc_id || chr(10) ELSE '# Document' END || chr(10) || '## Metadata' || chr(10) || '- Author: someone' || chr(10) || '- Pages: ' || n || chr(10) || body
      || CASE WHEN k > 0 THEN chr(10) || chr(10) || '## Images' || chr(10) || 'Total images: ' || k || repeat(chr(10) || '- Page 1: 2x3 (image/png)', least(k, 20)) || CASE WHEN k > 20 THEN chr(10) || '- ...and ' || (k - 20) || ' more' ELSE '' END ELSE '' END AS markdown FROM c""")
def markdown_doc(spark, sf_dir):
    """Markdown of results: title, metadata, pages, images up to the limit of the list."""
    return formats.to_markdown(_conversation_results(spark, sf_dir))


@query("""SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, CAST(count(*) AS INTEGER) AS page_count, CASE WHEN conv_id % 2 = 0 THEN 'Conversation ' || conv_id ELSE '' END AS title,
    string_agg(turn || ':' || text, chr(10) ORDER BY turn) AS pages, CASE WHEN conv_id % 4 = 0 THEN repeat('2x3 image/png AP8Q;', CAST(conv_id % 30 AS INTEGER)) ELSE '' END AS images FROM conversations GROUP BY conv_id""")
def json_doc(spark, sf_dir):
    """JSON texts, read again, with their pages and images (bytes as base64): the other engine prints them otherwise."""
    results = _conversation_results(spark, sf_dir).withColumn("images", F.transform("images", lambda i: i.withField("data", F.unhex(F.lit("00FF10")))))
    back = F.from_json("json", "text string, metadata struct<title string, page_count int>, pages array<struct<page_number int, text string>>, images array<struct<width int, height int, mime_type string, data string>>")
    r = formats.to_json(results).select("doc_id", back.alias("r")).select("doc_id", "r.*")
    pages = F.array_join(F.transform("pages", lambda p: F.concat(p["page_number"].cast("string"), F.lit(":"), p["text"])), "\n")
    images = F.array_join(F.transform("images", lambda i: F.concat(i["width"], F.lit("x"), i["height"], F.lit(" "), i["mime_type"], F.lit(" "), i["data"], F.lit(";"))), "")
    return r.select("doc_id", "text", "metadata.page_count", "metadata.title", pages.alias("pages"), images.alias("images"))


_TRIMMED = f"regexp_replace(regexp_replace({_PAGE_TEXT}, '\\r\\n?', chr(10), 'g'), '(?m)[\\t ]+$', '', 'g')"


@query(f"""{_PAGES} SELECT doc_id, '# ' || any_value(source) || chr(10) || chr(10) || '## Metadata' || chr(10) || '- Author: ' || any_value(lang) || chr(10) || '- Producer: leafmill' || chr(10) || '- Pages: ' || count(*) || chr(10)
    || string_agg(chr(10) || '## Page ' || n || chr(10) || chr(10) || {_TRIMMED}, chr(10) ORDER BY n) AS markdown FROM p JOIN (SELECT doc_id, source, lang FROM l) USING (doc_id) GROUP BY doc_id""")
def pdf_markdown(spark, sf_dir):
    """Whole path: bytes to Markdown, all pages."""
    return formats.to_markdown(parse(fixtures(spark, sf_dir), Options(max_pages=tables.ALL_PAGES)))


# -- relations

@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def xref_latest_wins(spark, sf_dir):
    """The newest entry of each object; ties go to the greater id."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return relational.latest_entries(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def xref_first_wins(spark, sf_dir):
    """The oldest entry of each object; ties go to the smaller id."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return relational.latest_entries(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def ref_resolution(spark, sf_dir):
    """References to the objects that they name; those to none keep nulls."""
    return relational.resolve_references(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def visited_anti(spark, sf_dir):
    """Nodes that no reference led to."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.unvisited(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), seen, ["c_custkey"])


@query("""WITH RECURSIVE e AS (SELECT -1 AS parent, 1000000 + r_regionkey AS node, CAST(r_regionkey AS BIGINT) AS ordinal FROM region UNION ALL SELECT 1000000 + n_regionkey, 2000000 + n_nationkey, n_nationkey FROM nation
      UNION ALL SELECT 2000000 + s_nationkey, 3000000 + s_suppkey, s_suppkey FROM supplier),
    t AS (SELECT CAST(-1 AS BIGINT) AS node, 0 AS depth, '' AS path UNION ALL SELECT e.node, t.depth + 1, t.path || '/' || e.ordinal FROM t JOIN e ON e.parent = t.node)
    SELECT CAST(node AS BIGINT) AS node, depth, path FROM t""")
def page_tree_recursive(spark, sf_dir):
    """Regions, nations and suppliers as a page tree, walked by a recursive query."""
    n = lambda base, c: (F.lit(base) + F.col(c)).cast("long")
    edges = (
        table(spark, sf_dir, "region").select(F.lit(-1).cast("long").alias("parent"), n(1_000_000, "r_regionkey").alias("node"), F.col("r_regionkey").cast("long").alias("ordinal"))
        .unionByName(table(spark, sf_dir, "nation").select(n(1_000_000, "n_regionkey").alias("parent"), n(2_000_000, "n_nationkey").alias("node"), F.col("n_nationkey").cast("long").alias("ordinal")))
        .unionByName(table(spark, sf_dir, "supplier").select(n(2_000_000, "s_nationkey").alias("parent"), n(3_000_000, "s_suppkey").alias("node"), F.col("s_suppkey").cast("long").alias("ordinal")))
    )
    walked = relational.walk_tree(edges, spark.range(1).select(F.lit(-1).cast("long").alias("node")))
    path = F.concat_ws("", F.transform("path", lambda x: F.concat(F.lit("/"), x.cast("string"))))
    return walked.select("node", "depth", path.alias("path"))


@query("""SELECT s_suppkey, attribute, CASE attribute WHEN 'region' THEN r_name WHEN 'name' THEN s_name ELSE coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'own' END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) END AS value
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(['region', 'name', 'font']) AS attribute)""")
def resource_inheritance(spark, sf_dir):
    """Attributes from region, nation and supplier: the deepest one that has it wins."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda d, a, v: F.struct(F.lit(d).alias("depth"), F.lit(a).alias("attribute"), v.alias("value"))
    none = F.lit(None).cast("string")
    levels = F.array(
        row(0, "region", F.col("r_name")), row(0, "font", F.col("r_name")), row(0, "name", F.col("r_name")), row(1, "name", F.col("n_name")), row(2, "name", F.col("s_name")),
        row(1, "font", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(none)), row(2, "font", F.when(F.col("s_suppkey") % 3 == 0, F.lit("own")).otherwise(none)),
    )
    held = s.select("s_suppkey", F.explode(levels).alias("r")).select("s_suppkey", "r.*").where("value is not null")
    return relational.inherit(held, "s_suppkey", "attribute", "value", "depth")


# -- character maps, geometry

@query("""WITH enc AS (SELECT code, CASE WHEN code = 128 THEN '€' WHEN code BETWEEN 160 AND 255 AND code <> 160 THEN chr(CAST(code AS INTEGER)) WHEN code = 160 THEN ' ' WHEN code BETWEEN 32 AND 126 THEN chr(CAST(code AS INTEGER)) END AS c FROM (SELECT unnest(range(32, 256)) AS code))
    SELECT p_partkey, CAST(code AS INTEGER) AS code, coalesce(CASE WHEN p_partkey % 224 + 32 = 65 THEN 'alpha' END, c) AS text FROM (SELECT p_partkey, 32 + p_partkey % 224 AS code FROM part) LEFT JOIN enc USING (code) WHERE code BETWEEN 32 AND 126 OR code = 128 OR code >= 160""")
def charmap_decode(spark, sf_dir):
    """Codes by ToUnicode entries, then a named encoding, then the code itself."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (32 + F.col("p_partkey") % 224).cast("int").alias("code"), F.lit("WinAnsiEncoding").alias("encoding"))
    parts = parts.where("code between 32 and 126 or code = 128 or code >= 160")
    unicode = spark.createDataFrame([(65, "alpha")], "code int, str string")
    return codes.decode_codes(parts, codes.encoding_table(spark), unicode).select("p_partkey", "code", "text")


@query("SELECT p_partkey, CAST(code AS INTEGER) AS code, chr(CAST(256 + p_partkey % 500 + code - p_size AS INTEGER)) AS char FROM (SELECT p_partkey, p_size, unnest(range(p_size, p_size + 1 + p_partkey % 5)) AS code FROM part)")
def bfrange_expand(spark, sf_dir):
    """Ranges of a character map, a row for each code."""
    ranges = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("first"), (F.col("p_size") + F.col("p_partkey") % 5).cast("int").alias("last"), (256 + F.col("p_partkey") % 500).cast("int").alias("target"))
    return codes.expand_ranges(ranges)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(2 * l_quantity + l_tax * l_discount + 10, 4) AS x, round(0.5 * l_quantity + 3 * l_discount - 4, 4) AS y, round(length(l_returnflag) * l_quantity * 0.55 * 50 / 100, 4) AS width FROM lineitem""")
def affine_transform(spark, sf_dir):
    """Points and widths through a matrix."""
    m: Column = F.array(F.lit(2.0), F.lit(0.5), F.col("l_tax"), F.lit(3.0), F.lit(10.0), F.lit(-4.0))
    identity = F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)))
    moved = geometry.transform(geometry.multiply(m, identity), F.col("l_quantity"), F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(moved["x"], 4).alias("x"), F.round(moved["y"], 4).alias("y"),
        F.round(geometry.estimated_width(F.col("l_returnflag"), F.col("l_quantity"), F.lit(50)), 4).alias("width"),
    )
