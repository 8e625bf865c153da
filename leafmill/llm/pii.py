"""Personal data: checked patterns as seeds, and bootstrapped contextual extraction of what they miss.

Base spans come from four checked patterns (e-mail, IP, card, phone). They are the seed entities: the words around them,
without punctuation and with digits as 0, become lexical patterns ("b _", "_ c", "a b _", "b _ c", "_ c d"). A scan of the
corpus gathers what else stands where a pattern with enough distinct seeds fits: candidates, which have a fitting shape
and may reach over several words, and other words. The bipartite graph of patterns and their distinct instances is scored
for some rounds: a pattern by the mean score of all that it holds, an instance by the patterns that hold it; other words count
against a pattern, once each. A last scan marks the candidates where patterns of high confidence fit.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, require, small_batches, staged

KINDS = ("email", "ip", "card", "phone")
#: Distinct seed instances that a pattern needs.
MIN_SEEDS = 5
#: Mean instance score from which a pattern marks new spans.
MIN_CONFIDENCE = 0.8
ROUNDS = 3
#: Patterns that one scan looks for; more of them take more scans.
PATTERNS_PER_SCAN = 200_000
#: Instances that a scan remembers, so as not to pass them on again.
PARTIAL_WORDS = 50_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'`.,;:!?()[]{}<>#*$%&|"
#: Shapes of identifiers that the checked patterns don't match, by kind; they may reach over several words.
_SHAPES = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]+(?:(?:@|\(at\)|\[at\])[\w-]+(?:(?:\.|\(dot\)|\[dot\])[\w-]+)*| (?:at|\(at\)|\[at\]) [\w-]+(?: (?:dot|\(dot\)|\[dot\]) [\w-]+)+)", re.I),
    "ip": re.compile(r"(?<![\w:])[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}(?![\w:])", re.I),
    "card": re.compile(r"(?<![\w])[0-9](?:[./_ -]?[0-9]){11,18}(?!\w)"),
    "phone": re.compile(r"(?<![\w])\(?[0-9](?:[()./ -]{0,2}[0-9]){6,14}(?!\w)"),
}

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping e-mail addresses, in time linear in the text: found from each @ outwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at + 1)):
            left = at
            while left > done and text[left - 1] in _LOCAL:
                left -= 1
            if left < at:
                out.append(("email", left, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    """Dotted groups of four numbers; a longer chain gives one per four of its numbers, from the left."""
    out = []
    for m in _DOTTED.finditer(text):
        if (chain := m.group()).count(".") < 3:
            continue
        parts, at = chain.split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    """All base spans, by start, then kind."""
    return in_order(emails(text) + ips(text) + cards(text) + phones(text))


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def contexts(before: list[str], after: list[str]) -> list[str]:
    """Lexical patterns of a place, from the two words before and the two after it."""
    out = []
    if before:
        out.append(f"{before[-1]} _")
        if len(before) > 1:
            out.append(f"{before[-2]} {before[-1]} _")
        if after:
            out.append(f"{before[-1]} _ {after[0]}")
    if after:
        out.append(f"_ {after[0]}")
        if len(after) > 1:
            out.append(f"_ {after[0]} {after[1]}")
    return out


class Words:
    """The words of a text, in lower case with digits as 0, and where they are."""

    def __init__(self, text: str):
        found = list(_WORD.finditer(text))
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.words = [_DIGIT.sub("0", m.group().lower()) for m in found]

    def around(self, a: int, b: int) -> list[str]:
        """Patterns of a span; a word that it cuts into counts as part of it."""
        i, j = bisect.bisect_right(self.ends, a), bisect.bisect_left(self.starts, b)
        return contexts(self.words[max(0, i - 2) : i], self.words[j : j + 2])

    def of(self, i: int) -> list[str]:
        """Patterns of the i-th word."""
        return contexts(self.words[max(0, i - 2) : i], self.words[i + 1 : i + 3])


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def seed_patterns(text: str) -> list[tuple[str, str, int]]:
    """(kind, pattern, instance) of each base span's places."""
    base = base_spans(text)
    words = Words(text) if base else None
    return [(kind, p, _key(text[a:b].lower())) for kind, a, b in base for p in words.around(a, b)]


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Places of a shape that overlap no base span."""
    starts, ends = [], []  # of base spans, joined where they overlap
    for _, x, y in base:
        if ends and x < ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)
    out = []
    for kind, shape in _SHAPES.items():
        for m in shape.finditer(text):
            a, b = m.span()
            while a < b and text[a] in _EDGE and text[a] != "(":
                a += 1
            while b > a and text[b - 1] in _EDGE and text[b - 1] not in ")]":
                b -= 1
            if any(c.isalnum() for c in text[a:b]) and bisect.bisect_right(ends, a) == bisect.bisect_left(starts, b):
                out.append((kind, a, b))
    return out


class Wanted:
    """Patterns looked for, by kind, and the words that a text needs for any of them to fit."""

    def __init__(self, patterns: dict[str, tuple[str, ...]]):
        self.patterns = patterns
        self.words = {next(w for w in p.split(" ") if w != "_") for p in patterns}

    def may_fit(self, text: str) -> bool:
        return bool(self.words) and not self.words.isdisjoint(_WORD.findall(_DIGIT.sub("0", text.lower())))

    def marked(self, text: str, base: list[Span]) -> list[tuple[str, str, int, int]]:
        """(pattern, kind, start, end) of the candidates where a pattern of their kind fits."""
        found = candidates(text, base)
        words = Words(text) if found else None
        return [(p, kind, a, b) for kind, a, b in found for p in words.around(a, b) if kind in self.patterns.get(p, ())]


def fitting(text: str, wanted: Wanted) -> tuple[set[tuple], set[tuple]]:
    """(pattern, kind, instance) of candidates, and of other words, where wanted patterns fit."""
    if not wanted.may_fit(text):
        return set(), set()
    base, words = base_spans(text), Words(text)
    found = candidates(text, base)
    held, other = set(), set()
    for kind, a, b in found:
        held.update((p, kind, _key(text[a:b].lower())) for p in words.around(a, b) if kind in wanted.patterns.get(p, ()))
    taken: dict[str, set[int]] = {k: set() for k in KINDS}  # words of base spans, and of candidates of the kind
    for kind, a, b in [*((k, x, y) for _, x, y in base for k in KINDS), *found]:
        taken[kind].update(range(bisect.bisect_right(words.ends, a), bisect.bisect_left(words.starts, b)))
    near = {i + d for i, word in enumerate(words.words) if word in wanted.words for d in (-1, 1, 2)}  # where the pattern of a wanted word may fit
    for i in near:
        if 0 <= i < len(words.words):
            for p in words.of(i):
                for kind in wanted.patterns.get(p, ()):
                    if i not in taken[kind]:
                        other.add((p, kind, _key(words.words[i])))
    return held, other


def _scan(patterns: dict[str, tuple[str, ...]], n_seeds: dict[tuple[str, str], int]):
    """A mapInArrow function over (text): rows of candidates (fits) and of other words, distinct as far as memory goes.

    A pattern that holds more other words than seeds has no confidence; once it does, it is looked for no longer, as the other
    words passed on so far are enough to show it.
    """

    @lean
    def scan(batches):
        wanted, live, told, counts = Wanted(patterns), dict(patterns), set(), Counter()
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                for fits, found in zip((True, False), fitting(text, wanted)):
                    for x in found:
                        if (x, fits) not in told:
                            told.add((x, fits))
                            rows.append((*x, fits))
                            counts[x[:2]] += not fits
                if any(n > n_seeds[p] for p, n in counts.items()):
                    for p, kind in [p for p, n in counts.items() if n > n_seeds[p]]:
                        live[p] = tuple(k for k in live[p] if k != kind)
                        del counts[p, kind]
                    live = {p: kinds for p, kinds in live.items() if kinds}
                    wanted = Wanted(live)
                if len(told) > PARTIAL_WORDS:
                    told.clear()
                    counts.clear()
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["pattern", "kind", "instance", "fits"])

    return scan


PLACES = "pattern string, kind string, instance long, fits boolean"


@lean
def _seeds(batches):
    schema = pa.schema([("kind", pa.string()), ("pattern", pa.string()), ("instance", pa.int64())])
    for batch in batches:
        rows = [r for text in batch.column(0).to_pylist() if text for r in seed_patterns(text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def score_graph(seeds: DataFrame, places: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) after some rounds over the pattern-instance graph; seeds and places are distinct.

    Patterns that hold more other words than seeds are no part of it.
    """
    others = places.where("not fits").groupBy("pattern", "kind").agg(F.count("*").alias("n_other"))
    supported = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("n_seeds")).join(others, ["pattern", "kind"], "left").fillna(0, ["n_other"])
    live = staged(supported.where("n_other <= n_seeds").select("pattern", "kind", "n_other"), "pii-live")
    held = places.where("fits").select("pattern", "kind", "instance").withColumn("seed", F.lit(False))
    edges = seeds.withColumn("seed", F.lit(True)).select("pattern", "kind", "instance", "seed").unionByName(held)
    edges = staged(edges.join(live.select("pattern", "kind"), ["pattern", "kind"], "left_semi"), "pii-edges")
    scores = edges.select("kind", "instance", "seed").distinct().groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for _ in range(rounds):
        patterns = (
            edges.join(scores, ["kind", "instance"]).groupBy("pattern", "kind").agg(F.sum("score").alias("good"), F.count("*").alias("held"))
            .join(live, ["pattern", "kind"]).select("pattern", "kind", (F.col("good") / (F.col("held") + F.col("n_other"))).alias("confidence"))
        )
        missed = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        scores = edges.join(patterns, ["pattern", "kind"]).groupBy("kind", "instance").agg(
            F.when(F.max("seed"), F.lit(1.0)).otherwise(1 - missed).alias("score")
        )
    return patterns


def trusted_patterns(documents: DataFrame) -> DataFrame | None:
    """(pattern, kind) of high confidence, staged; None if there is none."""
    spark = documents.sparkSession
    texts = documents.select(F.col("text").cast("string").alias("text"))
    seeds = staged(texts.mapInArrow(_seeds, "kind string, pattern string, instance long").distinct(), "pii-seeds")
    supported = staged(seeds.groupBy("pattern", "kind").agg(F.count("*").alias("n_seeds")).where(F.col("n_seeds") >= MIN_SEEDS), "pii-patterns")
    places = None
    for part in _parts(supported):
        patterns: dict[str, tuple[str, ...]] = {}
        n_seeds = {}
        for r in part.toLocalIterator():  # about PATTERNS_PER_SCAN rows
            patterns[r["pattern"]] = (*patterns.get(r["pattern"], ()), r["kind"])
            n_seeds[r["pattern"], r["kind"]] = r["n_seeds"]
        shared = spark.sparkContext.broadcast((patterns, n_seeds))
        found = texts.mapInArrow(lambda b, s=shared: _scan(*s.value)(b), PLACES)
        places = found if places is None else places.unionByName(found)
    if places is None:
        return None
    places = staged(places.distinct(), "pii-places")
    if places.where("fits").isEmpty():
        return None
    scored = score_graph(seeds.join(supported.select("pattern", "kind"), ["pattern", "kind"], "left_semi"), places)
    trusted = staged(scored.where(F.col("confidence") >= MIN_CONFIDENCE).select("pattern", "kind"), "pii-trusted")
    return None if trusted.isEmpty() else trusted


def _parts(patterns: DataFrame) -> list[DataFrame]:
    """patterns in parts of about PATTERNS_PER_SCAN rows; all kinds of a pattern are in one part."""
    n = -(-patterns.count() // PATTERNS_PER_SCAN)
    return [patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k) for k in range(n)]


FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("text", T.StringType()),
])


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; a span that begins within an earlier one is part of it."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find(documents: DataFrame, redacted: bool = False) -> DataFrame:
    """Personal data in every row: base counts, base_sha256, all spans and how many of them were added.

    n_email, n_ip, n_card and n_phone count base spans. Null texts are empty and hold nothing; repeated
    rows get equal results; null ids are kept, and spans are added to them as to others; an empty table gives no rows.
    With redacted, the column text holds the redacted text (null stays null) and row the document's own columns, whatever their names.
    """
    require(documents, "doc_id", "text")
    small_batches(documents)
    spark = documents.sparkSession
    trusted = trusted_patterns(documents)
    chunks = []
    for part in _parts(trusted) if trusted is not None else ():
        patterns: dict[str, tuple[str, ...]] = {}
        for r in part.toLocalIterator():  # about PATTERNS_PER_SCAN rows
            patterns[r["pattern"]] = (*patterns.get(r["pattern"], ()), r["kind"])
        chunks.append(spark.sparkContext.broadcast(patterns))
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*(documents[c] for c in documents.columns)).alias("row")] if redacted else []))
    schema = T.StructType([f for f in FOUND if redacted or f.name != "text"])
    if redacted:
        schema = schema.add("row", documents.schema)
    more = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    for k, chunk in enumerate(chunks[:-1]):  # only if there are more trusted patterns than one scan looks for
        keyed = keyed.mapInArrow(_adding(chunk, k > 0), T.StructType([*(f for f in keyed.schema if f.name != "found"), T.StructField("found", more)]))
    last, carried, names = chunks[-1] if chunks else None, len(chunks) > 1, schema.names

    @lean
    def spans(batches):
        wanted = Wanted(last.value) if last is not None else None
        for batch in batches:
            extra = batch.column(batch.schema.get_field_index("found")).to_pylist() if carried else [None] * batch.num_rows
            columns: list[list] = [[] for _ in range(8)]
            for text, held in zip(batch.column(1).to_pylist(), extra):
                base = base_spans(text or "")
                added = [(x["kind"], x["start"], x["end"]) for x in held or ()]
                if wanted is not None and text and wanted.may_fit(text):
                    added += [(kind, a, b) for _, kind, a, b in wanted.marked(text, base)]
                every = in_order(base + added)
                counts = Counter(s[0] for s in base)
                row = [*(counts[k] for k in KINDS), hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(every), len(every) - len(base)]
                row.append(redact(text, every) if redacted and text is not None else None)
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(2)] if redacted else arrays[:-1], names=names)

    return keyed.mapInArrow(spans, schema)


def _adding(chunk, carried: bool):
    """A mapInArrow function that adds what one part of the trusted patterns marks to the column found, the last one."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @lean
    def run(batches):
        wanted = Wanted(chunk.value)
        for batch in batches:
            held = batch.columns[:-1] if carried else batch.columns
            before = batch.column(batch.num_columns - 1).to_pylist() if carried else [None] * batch.num_rows
            found = []
            for text, own in zip(batch.column(1).to_pylist(), before):
                marked = wanted.marked(text, base_spans(text)) if text and wanted.may_fit(text) else []
                found.append([*(own or ()), *({"kind": kind, "start": a, "end": b} for _, kind, a, b in marked)])
            yield pa.RecordBatch.from_arrays([*held, pa.array(found, kind)], names=[*batch.schema.names[: len(held)], "found"])

    return run


def redact_documents(documents: DataFrame) -> DataFrame:
    """documents with personal data replaced in their texts, and n_chars (if there) counted anew."""
    found = find(documents, redacted=True)
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*(fresh.get(c, F.col(f"row.`{c}`")).cast(documents.schema[c].dataType).alias(c) for c in documents.columns))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query: personal data in every document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
