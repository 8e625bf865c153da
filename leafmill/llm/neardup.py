"""Near-duplicate documents: bottom-k sketches from one hash function, inverted lists, exact Jaccard.

A document is the set of its distinct 5-word shingles. One 64-bit hash orders all shingles; a document
retains the SKETCH least values. Documents with equal sets are one class from the start.

* Candidates. Two sets of Jaccard 0.75 share at least MIN_OVERLAP retained values, all but certainly (the count
  is binomial, 36 of 48 on average; sets that fit into their sketch share 3/7 of their joint size, certainly). With
  every sketch ordered by how many sketches hold a value, rarest first, two such sketches meet within a prefix, so only
  prefixes enter the inverted lists. Values of passages that thousands of documents share come last, and rarely enter.
* A list is linked as stars first: its members, by size class, with the least member of their own and the two
  neighbouring size classes. That is linear in the list, and joins groups of copies, however large.
* Every candidate passes the union-sketch estimate, then the exact Jaccard of the full sets of both texts.
* What the stars leave open - members of one list in different components - is compared in blocks, bounded in members and in
  bytes, of the same or neighbouring size classes; by sketches first and then by full sets, so no link depends on which member was a centre.
* Components come from rounds of contraction, with tables staged between rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, require, small_batches, staged

SHINGLE_WORDS = 5
THRESHOLD = 75  # percent
SKETCH = 48
MIN_OVERLAP = 22
#: Members of one block when the rest of a list is compared, and shingles of their full sets (8 bytes each), both on average.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Ids up to this many (16 bytes each) are broadcast to pick rows; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words than a shingle, of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE_WORDS + 1
    if n < 1:
        mixed = np.array([len(h)], np.uint64)
        for i, x in enumerate(h):
            mixed = _mix(mixed * _MULTIPLIERS[i] + x)
        return mixed
    mixed = np.zeros(n, np.uint64)
    for i in range(SHINGLE_WORDS):
        mixed = _mix(mixed * _MULTIPLIERS[i] + h[i : i + n])
    return np.unique(mixed)


def _bytes(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


@lean
def _sketches(batches):
    for batch in batches:
        n, key, sketch = [], [], []
        for text in _bytes(batch.column(1)):
            s = shingles(text)
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()))
            sketch.append((s[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64))  # signed order is then the hash's order
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketch])])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sketch) if sketch else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "sketch"])


SKETCHED = "doc_id long, n_shingles long, set_key binary, sketch array<long>"


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of undirected edges (a, b): label is the least node of the component.

    Each round maps every node to the least of itself and its neighbours and contracts the edges; paths
    shorten by at least half, stars end at once.
    """
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = staged(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "least")
        if labels is None:
            labels = least.select("node", F.col("to").alias("label"))
        else:
            labels = staged(labels.join(least.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        a, b = least.select(F.col("node").alias("a"), F.col("to").alias("ta")), least.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        edges = staged(moved.distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _picked(table: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """The rows of table whose node is in ids, without a shuffle of table while the ids are few."""
    return table.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "node", "left_semi")


@lean
def _confirm(batches):
    cache: dict[int, np.ndarray] = {}
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for i, (x, y, tx, ty) in enumerate(zip(a, b, _bytes(batch.column(2)), _bytes(batch.column(3)))):
            if x not in cache:
                cache = {x: shingles(tx)}
            sx, sy = cache[x], shingles(ty)
            shared = len(np.intersect1d(sx, sy, assume_unique=True))
            if 100 * shared >= THRESHOLD * (len(sx) + len(sy) - shared):
                keep.append(i)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["a", "b"])


def verify(candidates: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) whose sketches pass the union estimate and whose full sets reach the threshold, staged."""
    candidates = staged(candidates.distinct(), "candidates")
    nodes = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    near = staged(_estimated(candidates, _picked(classes, nodes, 2 * candidates.count())), "estimated")
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    full = _picked(texts, nodes, 2 * near.count())
    pairs = near.join(full.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(full.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return staged(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long"), "links")


def _estimated(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose least values of the union hold enough shared ones; exact where both sets fit into their sketches."""
    one = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    pairs = candidates.join(one, "a").join(two, "b").where(f"100 * n_a >= {THRESHOLD} * n_b and 100 * n_b >= {THRESHOLD} * n_a")
    least = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, SKETCH)
    both = F.array_intersect("s_a", "s_b")
    shared, all_shared = F.size(F.array_intersect(least, both)), F.size(both)
    whole = F.greatest("n_a", "n_b") <= SKETCH
    passes = F.when(whole, 100 * all_shared >= THRESHOLD * (F.col("n_a") + F.col("n_b") - all_shared)).otherwise(shared >= MIN_OVERLAP)
    return pairs.where(passes).select("a", "b")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(value, node, n): each class under the rarest of its retained values, as many as prefix_length asks; values of one class only are left out."""
    held = classes.select("node", "n", F.explode("sketch").alias("value"))
    shared = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    ranked = held.join(shared, "value").select("node", "n", "value", "df")
    of_node = Window.partitionBy("node", "n")
    alone = F.least("n", F.lit(SKETCH)) - F.count("*").over(of_node)
    rank = F.row_number().over(of_node.orderBy("df", "value"))
    small = F.col("n") - F.ceil(F.col("n") * THRESHOLD / 100) + 1
    prefix = F.when(F.col("n") * 4 <= 3 * SKETCH, small).otherwise(F.least("n", F.lit(SKETCH)) - MIN_OVERLAP + 1)
    return ranked.withColumns({"alone": alone, "rank": rank}).where(F.col("alone") + F.col("rank") <= prefix).select("value", "node", "n")


def _size_class(n: str):
    """Sets of a Jaccard index of 0.75 or more are in the same size class or neighbouring ones."""
    return F.floor(F.log(n) / F.lit(float(np.log(4 / 3)))).cast("long")


def stars(lists: DataFrame) -> DataFrame:
    """Candidate pairs: each member of a list with the least member of its size class and of the neighbouring ones."""
    sized = lists.withColumn("size", _size_class("n"))
    centres = sized.groupBy("value", "size").agg(F.min("node").alias("centre")).select("value", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "centre")
    pairs = sized.join(centres, ["value", "size"]).where("node <> centre")
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _shared(sets: list[np.ndarray]):
    """For each set in turn, how many values it shares with every set, through the inverted lists of all of them."""
    lengths = [len(s) for s in sets]
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(where, kind="stable")
    members, first = owner[order], np.searchsorted(where[order], np.arange(len(values) + 1))
    begin = np.concatenate([[0], np.cumsum(lengths)])
    for i in range(len(sets)):
        yield np.bincount(np.concatenate([members[first[v] : first[v + 1]] for v in where[begin[i] : begin[i + 1]]]), minlength=len(sets))


def _open_to(i: int, n: np.ndarray, label: np.ndarray, side: np.ndarray, diagonal: bool) -> np.ndarray:
    """Which members i is to be compared with: of another label, of a fitting size, off the diagonal of the other side."""
    fit = (label != label[i]) & (100 * n >= THRESHOLD * n[i]) & (100 * n[i] >= THRESHOLD * n)
    return fit if diagonal else fit & (side != side[i])


def near_members(n: np.ndarray, label: np.ndarray, side: np.ndarray, sketches: list[np.ndarray], diagonal: bool) -> np.ndarray:
    """Which members of a block pair share enough retained values with a member that they are to be compared with."""
    found = np.zeros(len(n), bool)
    for i, shared in enumerate(_shared(sketches)):
        need = np.where(np.maximum(n, n[i]) <= SKETCH, -(-3 * (n + n[i]) // 7), MIN_OVERLAP)
        fit = (shared >= need) & _open_to(i, n, label, side, diagonal)
        found |= fit
        found[i] |= fit.any()
    return found


def linking_pairs(node: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], diagonal: bool) -> list[tuple[int, int]]:
    """Links between the full sets of a block pair, as many as join its labels: none closes a circle."""
    root = {x: x for x in label.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, shared in enumerate(_shared(sets)):
        fit = (100 * shared >= THRESHOLD * (n + n[i] - shared)) & _open_to(i, n, label, side, diagonal)
        for k in np.nonzero(fit)[0]:
            a, b = find(int(label[i])), find(int(label[k]))
            if a != b:
                root[a] = b
                out.append((int(node[i]), int(node[k])))
    return out


def _by_group(batches, handle):
    """Rows of each (centre, one, two), which come together, as columns."""
    held, key = {}, None
    for batch in batches:
        columns = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
        for i, k in enumerate(zip(columns["centre"], columns["one"], columns["two"])):
            if k != key:
                if key is not None:
                    yield from handle(key, held)
                held, key = {c: [] for c in columns}, k
            for c, rows in held.items():
                rows.append(columns[c][i])
    if key is not None:
        yield from handle(key, held)


@lean
def _near(batches):
    def handle(key, held):
        if len(set(held["label"])) < 2:
            return
        n, label, side = (np.array(held[c], np.int64) for c in ("n", "label", "side"))
        keep = np.nonzero(near_members(n, label, side, [np.array(s, np.int64) for s in held["sketch"]], key[1] == key[2]))[0]
        if len(keep):
            columns = [np.full(len(keep), k) for k in key] + [np.array(held["node"], np.int64)[keep], label[keep], side[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["centre", "one", "two", "node", "label", "side"])

    yield from _by_group(batches, handle)


@lean
def _link(batches):
    def handle(key, held):
        node, label, side = (np.array(held[c], np.int64) for c in ("node", "label", "side"))
        sets = [np.frombuffer(s, np.uint64) for s in held["full"]]
        found = linking_pairs(node, np.array([len(s) for s in sets]), label, side, sets, key[1] == key[2])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    yield from _by_group(batches, handle)


@lean
def _full_sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in _bytes(batch.column(1))], pa.binary())], names=["node", "full"])


def rest(lists: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The links that the stars left open, staged: among members of one list whose components differ.

    Lists with the same least member are joined, as those of one passage or one group of copies mostly are, and cut into
    blocks by size class. The sketches tell which members of a pair of blocks have someone to be compared with; only their full
    sets are sent after them, and compared there. What comes out is linear in the members.
    """
    labelled = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_lists = labelled.groupBy("value").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("centre"))
    open_lists = open_lists.where("size > 2 and low <> high").select("value", "centre")
    members = staged(labelled.join(open_lists, "value").select("centre", "node", "n", "label").distinct().withColumn("class", _size_class("n")), "open-members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    sizes = members.groupBy("centre", "class").agg(blocks.alias("blocks"))
    code = lambda block: F.col("class") * F.lit(1 << 40) + block  # noqa: E731 of a block: its class, and its number there
    side = members.join(sizes, ["centre", "class"]).withColumn("side", code(F.pmod(F.xxhash64("node"), F.col("blocks"))))
    targets = sizes.select("centre", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).select("centre", code(F.col("block")).alias("other"), F.explode(F.array(*(F.col("class") + d for d in (-1, 0, 1)))).alias("class"))
    paired = side.join(targets, ["centre", "class"]).withColumns({"one": F.least("side", "other"), "two": F.greatest("side", "other")})
    sketches = _picked(classes, members.select("node").distinct(), members.count())
    rows = paired.join(sketches, ["node", "n"]).select("centre", "one", "two", "node", "n", "label", "side", "sketch")
    rows = rows.repartition("centre", "one", "two").sortWithinPartitions("centre", "one", "two")
    near = staged(rows.mapInArrow(_near, "centre long, one long, two long, node long, label long, side long"), "near-members")
    nodes = near.select("node").distinct()
    full = _picked(texts, nodes, near.count()).select("node", "text").mapInArrow(_full_sets, "node long, full binary").distinct()
    rows = near.join(full, "node").repartition("centre", "one", "two").sortWithinPartitions("centre", "one", "two")
    return staged(rows.select("centre", "one", "two", "node", "label", "side", "full").mapInArrow(_link, "a long, b long"), "more-links")


def deduplicate(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents.

    component_id is the least doc_id that links reach; kept is doc_id = component_id. Null and empty texts,
    and texts without words, have no shingles and no links. Rows that share a doc_id are one document: what
    one of them is linked with, all are; each is kept if the id is its component's least. A row with a null
    doc_id joins no component (component_id null) and is kept. An empty table gives no rows.
    """
    require(documents, "doc_id", "text")
    small_batches(documents)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = staged(texts.mapInArrow(_sketches, SKETCHED), "sketched")
    linkable = sketched.where("n_shingles > 0 and doc_id is not null")
    leaders = linkable.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    copies = linkable.select("set_key", "doc_id").distinct().join(leaders, "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    leading = leaders.select(F.col("node").alias("doc_id"), "set_key")
    classes = linkable.join(leading, ["doc_id", "set_key"], "left_semi").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch").distinct()
    classes = staged(classes, "classes")
    lists = staged(inverted_lists(classes), "lists")
    whole = texts.withColumnRenamed("doc_id", "node").where("node is not null")
    links = verify(stars(lists), classes, whole)
    more = rest(lists, components(links), classes, whole)
    labels = components(links.unionByName(more).unionByName(copies))
    return sketched.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("label", "doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component, with all its columns; rows with a null doc_id stay."""
    dropped = staged(deduplicate(documents).where("not kept").select(F.col("doc_id").alias("dropped_id")).distinct(), "dropped")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return documents.join(dropped, documents["doc_id"].cast("long") == dropped["dropped_id"], "left_anti")


def op9_neardup(spark, sf_dir: str) -> DataFrame:
    """Contract query: the near-duplicate component of every document."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract by brute force: all pairs that share a shingle, then the transitive closure.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""
