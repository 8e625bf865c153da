"""Maximum inner product search with score-aware (anisotropic) product quantisation.

A vector is cut into subspaces of a few components, each coded in four bits. Codebooks are fitted, and codes
chosen, for a loss that weighs the part of the residual parallel to the vector more than the rest, as that part moves the
inner products that matter: those of queries that score high. The fit is on a bounded sample (SAMPLE_VECTORS, by the least hashes
of vec_id); every vector is coded and searched.

Vectors are coded once, and stored with their codes. A scan looks up sums of query tables by code, two codes a byte, in blocks of
rows; each block's best RERANK vectors by these sums are scored exactly, in double precision, and merged into the query's
best k. Queries come in bounded chunks that are broadcast, so one scan of the vectors serves a whole chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require, staged

SAMPLE_VECTORS = 20_000
SUBSPACE = 2
#: Weight of the parallel part of the residual, relative to the rest.
PARALLEL = 4.0
RERANK = 192
#: Queries of one broadcast, and rows of one block.
QUERY_CHUNK = 8192
BLOCK_ROWS = 16_384
#: Repeated ids up to this many are broadcast; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


@dataclass
class Codebooks:
    """centres[m, 16, SUBSPACE]; vectors are padded with zeros to m * SUBSPACE components."""

    centres: np.ndarray
    dim: int

    def pad(self, x: np.ndarray) -> np.ndarray:
        m = self.centres.shape[0]
        return np.pad(x, ((0, 0), (0, m * SUBSPACE - x.shape[1]))).reshape(len(x), m, SUBSPACE)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (n, m) by coordinate descent on the anisotropic loss, from the nearest centres."""
        x = self.pad(x.astype(np.float32))
        return _assign(x, self.centres, rounds)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Sums for each byte of two codes: (bytes, queries, 256)."""
        one = np.einsum("qms,mcs->mqc", self.pad(queries.astype(np.float32)), self.centres)
        if len(one) % 2:
            one = np.concatenate([one, np.zeros_like(one[:1])])
        return np.ascontiguousarray((one[0::2, :, :, None] + one[1::2, :, None, :]).reshape(len(one) // 2, one.shape[1], 256), np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def _directions(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum((1, 2), keepdims=True))
    return x / np.maximum(norm, 1e-30)


def _assign(x: np.ndarray, centres: np.ndarray, rounds: int, codes: np.ndarray | None = None) -> np.ndarray:
    n, m, _ = x.shape
    u = _directions(x)
    if codes is None:
        codes = np.stack([((x[:, j, None] - centres[j][None]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
    along = np.stack([(u[:, j] * (x[:, j] - centres[j][codes[:, j]])).sum(1) for j in range(m)], 1)
    total = along.sum(1)
    for _ in range(rounds):
        for j in range(m):
            residual = x[:, j, None] - centres[j][None]
            here = np.einsum("ns,ncs->nc", u[:, j], residual)
            cost = (residual**2).sum(2) + (PARALLEL - 1) * (total[:, None] - along[:, j, None] + here) ** 2
            codes[:, j] = cost.argmin(1)
            chosen = here[np.arange(n), codes[:, j]]
            total += chosen - along[:, j]
            along[:, j] = chosen
    return codes


def fit(sample: np.ndarray, seed: int = 5, rounds: int = 8) -> Codebooks:
    """Codebooks by alternating assignment and weighted least squares of each centre."""
    dim = sample.shape[1]
    m = -(-dim // SUBSPACE)
    x = np.pad(sample.astype(np.float32), ((0, 0), (0, m * SUBSPACE - dim))).reshape(len(sample), m, SUBSPACE)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), 16, replace=len(x) < 16)].transpose(1, 0, 2).copy()
    u, codes = _directions(x), None
    for _ in range(rounds):
        codes = _assign(x, centres, 1, codes)
        for j in range(m):
            residual = [(u[:, i] * (x[:, i] - centres[i][codes[:, i]])).sum(1) for i in range(m)]
            others = np.sum(residual, 0) - residual[j]
            goal = others + (u[:, j] * x[:, j]).sum(1)
            for c in range(16):
                rows = codes[:, j] == c
                if not rows.any():
                    continue
                w = u[rows, j].astype(np.float64)
                left = rows.sum() * np.eye(SUBSPACE) + (PARALLEL - 1) * w.T @ w
                right = x[rows, j].sum(0) + (PARALLEL - 1) * w.T @ goal[rows]
                centres[j, c] = np.linalg.solve(left, right)
    return Codebooks(centres.astype(np.float32), dim)


class Search:
    """The k best of each query so far, over blocks of vectors."""

    def __init__(self, books: Codebooks, ids: np.ndarray, queries: np.ndarray, k: int, rerank: int):
        self.books, self.ids, self.queries, self.k, self.rerank = books, ids, queries, k, rerank
        self.tables = None
        self.best_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.best = np.full((len(ids), k), -np.inf)

    def block(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray) -> None:
        """Search a block: ids are distinct; codes as packed() gives them."""
        order = np.argsort(ids, kind="stable")
        ids, vectors, codes = ids[order], vectors[order], codes[order]
        # Copies of a vector tie: only its k + 1 least ids can be among the k best (one may be the query itself).
        _, inverse, counts = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True, return_counts=True)
        if counts.max() > self.k + 1:
            grouped = np.argsort(inverse, kind="stable")
            rank = np.arange(len(ids)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            keep = np.sort(grouped[rank <= self.k])
            ids, vectors, codes = ids[keep], vectors[keep], codes[keep]
        near = None  # no more vectors than are reranked: all of them are
        step = max(1, 4_000_000 // len(ids))
        for a in range(0, len(self.ids), step):
            b = min(len(self.ids), a + step)
            if len(ids) > self.rerank:
                tables = self.books.tables(self.queries[a:b])
                sums = tables[0][:, codes[:, 0]]
                for j in range(1, codes.shape[1]):
                    sums += tables[j][:, codes[:, j]]
                near = np.argpartition(-sums, self.rerank, axis=1)[:, : self.rerank]
            for q in range(a, b):
                rows = near[q - a] if near is not None else slice(None)
                self._merge(q, ids[rows], (vectors[rows] * self.queries[q]).sum(1))

    def _merge(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = (ids != self.ids[q]) & (scores >= self.best[q, -1])
        if not other.any():
            return
        ids, scores = np.concatenate([self.best_ids[q], ids[other]]), np.concatenate([self.best[q], scores[other]])
        top = np.lexsort((ids, -scores))[: self.k]
        self.best_ids[q], self.best[q] = ids[top], scores[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = np.nonzero(self.best > -np.inf)
        return self.ids[q], self.best_ids[q, r], self.best[q, r]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows whose vector is not null, not zero and finite in all components."""
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))


def one_per_id(good: DataFrame) -> DataFrame:
    """good (vec_id, v) with one row per vec_id: the least vector, in order of components, of an id that repeats.

    Only ids are shuffled to find those; vectors of ids that occur once stay where they are.
    """
    repeated = staged(good.groupBy("vec_id").agg(F.count("*").alias("times")).where("times > 1").select("vec_id"), "repeated-ids")
    n = repeated.count()
    if not n:
        return good
    small = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
    again = good.join(small, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return good.join(small, "vec_id", "left_anti").unionByName(again)


def search(vectors: DataFrame, every: int = 20, k: int = 20, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by every.

    Scores are exact inner products; nearest first, ties to the smaller vec_id. All other rows are candidates.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Vectors of
    different lengths have no inner product: a query's candidates are those of its own length. Of rows that share a vec_id one
    takes part, with the least vector in order of components; a query never finds its own id. An empty table gives no rows.
    """
    require(vectors, "vec_id", "embedding")
    spark = vectors.sparkSession
    good = staged(one_per_id(usable(vectors)), "vectors")
    sizes = [r["dim"] for r in good.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]
    found = None
    for dim in sizes:
        near = _search_length(good.where(F.size("v") == dim), dim, every, k, rerank)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _coded(good: DataFrame, books, dim: int) -> DataFrame:
    """good with the packed code of each vector, staged."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            codes = packed(books.value.encode(x)) if batch.num_rows else np.empty((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "code"])

    return staged(good.mapInArrow(run, "vec_id long, v array<double>, code binary"), "coded")


def _search_length(good: DataFrame, dim: int, every: int, k: int, rerank: int) -> DataFrame:
    """(query_id, vec_id, score): k candidates or more of each query, over vectors of one length, staged by chunk of queries."""
    spark = good.sparkSession
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_VECTORS).select("v")
    books = spark.sparkContext.broadcast(fit(np.array([r["v"] for r in sample.toLocalIterator()])))
    coded = _coded(good, books, dim)
    queries = coded.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    chunks = max(1, -(-queries.count() // QUERY_CHUNK))
    found = None
    for c in range(chunks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).orderBy("vec_id").collect()  # about QUERY_CHUNK rows
        chunk = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in part], np.int64), np.array([r["v"] for r in part], np.float64).reshape(len(part), dim)))

        def scan(batches, chunk=chunk):
            ids, points = chunk.value
            if not len(ids):
                return
            state, held, size = Search(books.value, ids, points, k, rerank), [], 0

            def flush():
                own, vectors, codes = (np.concatenate(x) for x in zip(*held))
                state.block(own, np.ascontiguousarray(vectors), codes)

            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                held.append((batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim), codes))
                size += batch.num_rows
                if size >= BLOCK_ROWS:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            q, v, s = state.rows()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

        near = staged(coded.mapInArrow(scan, "query_id long, vec_id long, score double"), "nearest")
        found = near if found is None else found.unionByName(near)
    return found


def op1_ann(spark, sf_dir: str) -> DataFrame:
    """Contract query: the 20 nearest of every 20th vector among all vectors."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
