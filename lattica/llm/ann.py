"""Nearest neighbours by largest inner product: anisotropic product quantisation, 4-bit table scans, exact reranking.

index() fits a codebook (PAIR dimensions a subspace, 16 centroids each) on at most SAMPLE vectors, chosen by
a hash of the id, and encodes every vector. The loss weighs the part of the residual that is parallel to the
vector by eta = (dim - 1) T^2 / (1 - T^2), as that part moves large inner products; codes are chosen by
coordinate descent and centroids by the closed form for that loss. Equal vectors are indexed once, with their
smallest ids, so a very common vector is one entry.

search() sends BLOCK_QUERIES queries at a time to all tasks, each of which scans its part of the index as it is
stored, BLOCK_ROWS entries at a time, so no entry is shuffled. Tables of partial inner products (two 4-bit codes a
byte) give approximate scores; all entries at or above the RERANK-th of a block, ties included, are scored again
exactly in double precision, and those that reach the query's k-th best so far are merged into its k best. A task
returns k rows for each query, whatever the length of its part. A query's own id is left out.

The query set meets all rows, so work is their product, as the exact search that it replaces; memory and what is
broadcast are bounded by the blocks.

Edge cases: vectors that are null, zero, hold null or non-finite components, or differ in length from most,
take no part, as rows or queries; a null id takes no part; rows that repeat an id count once for each
different vector; fewer candidates than k are all returned; ties go to the smaller id; an empty table gives
an empty result. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, env_threads

SAMPLE, PAIR, THRESHOLD, ROUNDS = 8192, 2, 0.2, 4
RERANK, BLOCK_ROWS, BLOCK_QUERIES = 200, 8192, 16384


def _flat(col: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list column of equal lengths, as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


@dataclass
class Codebook:
    """centroids: (subspaces, 16, PAIR); subspaces is even, the dimensions padded with zeros."""

    centroids: np.ndarray
    eta: float
    dim: int

    def split(self, x: np.ndarray) -> np.ndarray:
        m = len(self.centroids)
        out = np.zeros((len(x), m * PAIR), np.float32)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, PAIR)

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        xs = self.split(x)
        us = xs / np.maximum(np.sqrt((xs**2).sum((1, 2), keepdims=True)), 1e-30)
        c = self.centroids
        codes = np.stack([((xs[:, m, None, :] - c[m][None]) ** 2).sum(2).argmin(1) for m in range(len(c))], axis=1)
        chosen = np.stack([c[m][codes[:, m]] for m in range(len(c))], axis=1)
        part = ((xs - chosen) * us).sum(2)
        total = part.sum(1)
        for _ in range(rounds):
            before = codes.copy()
            for m in range(len(c)):
                r = xs[:, m, None, :] - c[m][None]
                along = (r * us[:, m, None, :]).sum(2)
                rest = total - part[:, m]
                codes[:, m] = ((r**2).sum(2) + (self.eta - 1) * (rest[:, None] + along) ** 2).argmin(1)
                part[:, m] = along[np.arange(len(xs)), codes[:, m]]
                total = rest + part[:, m]
            if np.array_equal(before, codes):
                break
        return codes.astype(np.uint8)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what each byte of two codes adds to the inner product."""
        t = np.einsum("qmd,mkd->qmk", self.split(q), self.centroids).astype(np.float32)
        return (t[:, 1::2, :, None] + t[:, 0::2, None, :]).reshape(len(q), -1, 256)


def fit(x: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Codebook:
    """Start from k-means in each subspace, then alternate codes and the closed-form centroids of the anisotropic loss."""
    dim = x.shape[1]
    m = -(-dim // PAIR)
    m += m % 2
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    book = Codebook(np.zeros((m, 16, PAIR), np.float32), eta, dim)
    xs = book.split(x)
    rng = np.random.default_rng(seed)
    for s in range(m):
        c = xs[rng.integers(0, len(xs), 16), s].copy()
        for _ in range(12):
            near = ((xs[:, s, None, :] - c[None]) ** 2).sum(2).argmin(1)
            n = np.bincount(near, minlength=16)
            for d in range(PAIR):
                c[:, d] = np.where(n > 0, np.bincount(near, xs[:, s, d], 16) / np.maximum(n, 1), c[:, d])
            c[n == 0] = xs[rng.integers(0, len(xs), int((n == 0).sum())), s]
        book.centroids[s] = c
    us = xs / np.maximum(np.sqrt((xs**2).sum((1, 2), keepdims=True)), 1e-30)
    for _ in range(rounds):
        codes = book.encode(x)
        # minimise sum |x - P c|^2 + (eta - 1) (u . (x - P c))^2 over all centroids c together
        at = (np.arange(m)[None] * 16 + codes)[:, :, None] * PAIR + np.arange(PAIR)
        g = np.zeros((len(x), m * 16 * PAIR), np.float32)
        np.put_along_axis(g, at.reshape(len(x), -1), us.reshape(len(x), -1), axis=1)
        count = np.bincount(at.ravel(), minlength=g.shape[1])
        a = (eta - 1) * (g.T @ g).astype(np.float64)
        a[np.diag_indices_from(a)] += count + 1e-3
        b = np.bincount(at.ravel(), xs.reshape(len(x), -1).ravel(), g.shape[1]) + (eta - 1) * (g.T @ (us * xs).sum((1, 2)))
        b += 1e-3 * book.centroids.ravel()
        book.centroids = np.linalg.solve(a, b).reshape(m, 16, PAIR).astype(np.float32)
    return book


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array of doubles) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["d"] if size else 0))


@dataclass
class Index:
    book: Codebook | None
    entries: DataFrame  # v, ids (smallest first, at most `ids` of them), code
    vectors: DataFrame  # id, v
    scratch: Scratch


def index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", ids: int = 21, sample: int = SAMPLE) -> Index:
    """Fit on a bounded sample, encode every vector; the index is a table in the shared folder."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.keep(usable(vectors, id_col, vec_col), "vectors")
    # equal vectors: the rank limit is applied before the shuffle too, so a common vector sends a few ids a task
    first = rows.withColumn("_an_r", F.dense_rank().over(W.partitionBy("v").orderBy("id"))).where(F.col("_an_r") <= ids)
    entries = first.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("id")), 1, ids).alias("ids"))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    if not chosen.num_rows:
        return Index(None, scratch.keep(entries.withColumn("code", F.lit(b"")), "index"), rows, scratch)
    env_threads()
    book = fit(_flat(chosen["v"], np.float32))
    sent = spark.sparkContext.broadcast(book)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env_threads()
        for b in batches:
            if b.num_rows:
                code = sent.value.pack(sent.value.encode(_flat(b.column(0), np.float32)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in code], pa.binary())], ["v", "ids", "code"])

    return Index(book, scratch.keep(entries.mapInArrow(encode, "v array<double>, ids array<long>, code binary"), "index"), rows, scratch)


class _Best:
    """The k best of each query so far: scores and ids, best first, ties to the smaller id."""

    def __init__(self, names: np.ndarray, qs: np.ndarray, book: Codebook, k: int, rerank: int):
        self.names, self.qs, self.book, self.k, self.rerank = names, qs, book, k, rerank
        self.score = np.full((len(names), k), -np.inf)
        self.id = np.full((len(names), k), np.iinfo(np.int64).max)

    def scan(self, t: pa.Table) -> None:
        """Entries v, ids, code against all queries."""
        x = _flat(t["v"])
        code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        code = np.ascontiguousarray(code.T).astype(np.intp)
        ids = t["ids"].combine_chunks()
        bound, ids = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
        most = min(self.rerank, len(x))
        for a in range(0, len(self.qs), 64):
            tables = self.book.tables(self.qs[a : a + 64])
            near = np.zeros((len(tables), len(x)), np.float32)
            for n in range(code.shape[0]):
                near += np.take(tables[:, n, :], code[n], axis=1)
            cut = np.partition(near, len(x) - most, axis=1)[:, len(x) - most]
            for n in range(len(tables)):
                self._merge(a + n, np.flatnonzero(near[n] >= cut[n]), x, bound, ids)

    def _merge(self, q: int, at: np.ndarray, x: np.ndarray, bound: np.ndarray, ids: np.ndarray) -> None:
        exact = (x[at] * self.qs[q]).sum(1)
        ok = exact >= self.score[q, -1]  # the bound that the blocks before set
        at, exact = at[ok], exact[ok]
        if not len(at):
            return
        size = bound[at + 1] - bound[at]
        own = ids[np.repeat(bound[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        score = np.repeat(exact, size)
        other = own != self.names[q]
        score, own = np.concatenate((self.score[q], score[other])), np.concatenate((self.id[q], own[other]))
        o = np.lexsort((own, -score))
        # an id that stands for several vectors counts once, by its best
        o = o[np.sort(np.unique(own[o], return_index=True)[1])] if len(np.unique(own)) < len(own) else o
        o = o[: self.k]
        self.score[q, : len(o)], self.id[q, : len(o)] = score[o], own[o]
        self.score[q, len(o) :], self.id[q, len(o) :] = -np.inf, np.iinfo(np.int64).max

    def rows(self) -> pa.RecordBatch:
        q, r = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(self.names[q], pa.int64()), pa.array(self.id[q, r], pa.int64()), pa.array(self.score[q, r], pa.float64())], ["query_id", "vec_id", "score"])


def search(ix: Index, queries: DataFrame, k: int = 20, rerank: int = RERANK) -> DataFrame:
    """queries: id, v; of rows that repeat an id, one counts. Returns query_id, rank, vec_id, score."""
    spark = ix.vectors.sparkSession
    if ix.book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = ix.scratch.keep(queries.select("id", "v").dropDuplicates(["id"]), "queries")
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    found = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else queries
        asked = part.toArrow()  # BLOCK_QUERIES rows or so
        if not asked.num_rows:
            continue
        sent = spark.sparkContext.broadcast((ix.book, asked["id"].to_numpy(), _flat(asked["v"])))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            env_threads()
            book, names, qs = sent.value
            best, held, n = _Best(names, qs, book, k, rerank), [], 0
            for b in batches:
                for at in range(0, b.num_rows, BLOCK_ROWS):
                    held.append(b.slice(at, BLOCK_ROWS))
                    n += held[-1].num_rows
                    if n >= BLOCK_ROWS:
                        best.scan(pa.Table.from_batches(held))
                        held, n = [], 0
            if n:
                best.scan(pa.Table.from_batches(held))
            yield best.rows()

        part = ix.scratch.keep(ix.entries.mapInArrow(scan, "query_id long, vec_id long, score double"), f"found-{block}")
        sent.unpersist()
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # an id that stands for several vectors is one neighbour
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> DataFrame:
    """The k nearest of each row that is_query (on column id) admits, against all others."""
    ix = index(vectors, id_col, vec_col, ids=k + 1)
    return search(ix, ix.vectors.where(is_query), k)
