"""Approximate nearest neighbours by largest inner product: adaptive dimension scan within inverted lists.

An added coordinate sqrt(M^2 - |x|^2), M the largest norm, turns largest inner product into least distance. Lists are cells of a
k-means fit on a bounded sample. Within each probed list, vectors are turned by a random rotation and read in blocks of columns;
after each block, a candidate whose partial distance, by a hypothesis test, already exceeds the query's bound is abandoned.
The bound is about the k-th least distance to those of the sample that lie in probed lists, so it holds before any list is read. Survivors get their exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import table, written

#: The sample for k-means and bounds; the most lists; rows of a list, and queries, that meet in one task; columns of a block; pairs held at once;
#: how many more than k of the sample's vectors in the probed lists the bound leaves room for.
SAMPLE, MOST_LISTS, LIST_PART, QUERY_PART, COLUMNS, PAIRS, SPARE = 20_000, 4096, 8192, 20_000, 16, 200_000, 8


@dataclass
class Model:
    """What every task needs: bounded by SAMPLE and MOST_LISTS vectors."""

    most: float  # the largest squared norm
    turn: np.ndarray
    centres: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with the added coordinate, turned."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.most - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, more]) @ self.turn


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T)


def k_means(x: np.ndarray, n: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    centres = x[np.random.default_rng(seed).permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        own = np.concatenate([distances(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return np.unique(centres, axis=0)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of vectors that take part: not null, not zero, all components finite; v as doubles. Rows of one vec_id count
    as one vector, the least; rows without an id take no part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where("vec_id is not null and embedding is not null").where(fine).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("v"))


def scan(model: Model, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int, strict: float = 1.5) -> list[tuple[np.ndarray, ...]]:
    """(query ids, ids, inner products) of each query's k best here, as far as the scan keeps them.

    The partial squared distance over d of D turned columns, times D / d, estimates the whole one; a candidate goes once this
    exceeds the bound by the factor (1 + strict / sqrt(d))^2. Pairs held at once: PAIRS, or one query's.
    """
    turned, asked = model.lifted(x), model.lifted(q, query=True)
    width, out = turned.shape[1], []
    step = max(1, PAIRS // max(1, len(x)))
    for at in range(0, len(q), step):
        seen = min(COLUMNS, width)
        partial = distances(asked[at : at + step, :seen], turned[:, :seen])
        partial[query_ids[at : at + step, None] == ids[None, :]] = np.inf
        mine = np.repeat(np.arange(at, at + len(partial)), len(x))
        other, partial = np.tile(np.arange(len(x)), len(partial)), partial.ravel()
        while True:
            slack = strict / sqrt(seen) if seen < width else 1e-9
            keep = np.isfinite(partial) & (partial * (width / seen) <= bounds[mine] * (1 + slack) ** 2 + 1e-12)
            mine, other, partial = mine[keep], other[keep], partial[keep]
            if seen == width or not len(mine):
                break
            to = min(seen + COLUMNS, width)
            off = turned[other, seen:to] - asked[mine, seen:to]
            partial, seen = partial + np.einsum("ij,ij->i", off, off), to
        score = np.einsum("ij,ij->i", x[other], q[mine])
        order = np.lexsort((ids[other], -score, mine))
        mine, other, score = mine[order], other[order], score[order]
        begin = np.searchsorted(mine, mine)
        best = np.arange(len(mine)) - begin < k
        out.append((query_ids[mine[best]], ids[other[best]], score[best]))
    return out


def probes_for(model: Model, k: int, wanted: float, asked: int = 400) -> int:
    """Lists to probe so that at least the wanted share of the true neighbours, among the sample, are in a probed list."""
    x = model.lifted(model.sample)
    own = np.concatenate([distances(x[i : i + 4096], model.centres).argmin(axis=1) for i in range(0, len(x), 4096)])
    q = model.lifted(model.sample[:asked], query=True)
    d = distances(q, x)
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
    place = distances(q, model.centres).argsort(axis=1).argsort(axis=1)
    ranks = np.take_along_axis(place, own[near], axis=1).ravel()
    return int(np.quantile(ranks, wanted, method="higher")) + 1 if len(ranks) else 1


def fit(vectors: DataFrame, most: float, n: int, width: int, k: int, lists: int | None) -> Model:
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    turn = np.linalg.qr(np.random.default_rng(11).standard_normal((width + 1, width + 1)))[0]
    sample = np.array([r.v for r in rows], float).reshape(-1, width)
    model = Model(most, turn, np.zeros((0, width + 1)), sample, np.array([r.vec_id for r in rows], np.int64))
    model.centres = k_means(model.lifted(sample), min(MOST_LISTS, lists or max(1, round(sqrt(n)))))
    return model


def search(vectors: DataFrame, every: int = 20, k: int = 20, lists: int | None = None, wanted: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries with vec_id divisible by `every`, against all other vectors of (vec_id, embedding).

    Vectors of another length than the most common one take no part either. Fewer candidates than k give fewer rows; an
    empty table, or one vector alone, gives none. Ties go to the smaller vec_id. A list with many rows is read in parts of about
    LIST_PART rows, drawn by a hash of the id, so one very common vector is no hot task; each part gives at most k rows a query.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine, _ = written(usable(vectors))
    shapes = fine.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).orderBy(F.desc("n"), "width").first()
    if shapes is None:
        return none
    width, n = shapes["width"], shapes["n"]
    fine = fine.where(F.size("v") == width)
    model = fit(fine, shapes["most"], n, width, k, lists)
    probes = min(probes_for(model, k, wanted), len(model.centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                own = distances(model.lifted(matrix(part.column(1), width)), model.centres).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.astype(np.int32))], ["vec_id", "v", "list"])

    indexed, _ = written(fine.mapInArrow(assign, "vec_id long, v array<double>, list int"))
    sizes = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}
    parts = np.array([ceil(sizes.get(i, 0) / LIST_PART) for i in range(len(model.centres))])
    per_list = F.array(*(F.lit(int(p)) for p in np.maximum(1, parts)))
    query_parts = max(1, ceil(n / every * probes / len(model.centres) / QUERY_PART))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = model.lifted(model.sample)
        home = np.concatenate([distances(sample[i : i + 4096], model.centres).argmin(axis=1) for i in range(0, len(sample), 4096)])
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                q, ids = matrix(part.column(1), width), part.column(0).to_numpy()
                asked = model.lifted(q, query=True)
                d = distances(asked, sample)
                d[ids[:, None] == model.sample_ids[None, :]] = np.inf
                near = np.argpartition(distances(asked, model.centres), probes - 1, axis=1)[:, :probes]
                probed = np.zeros((len(q), len(model.centres)), bool)
                np.put_along_axis(probed, near, True, axis=1)
                d[~probed[:, home]] = np.inf
                bound = np.partition(d, k + SPARE, axis=1)[:, k + SPARE] if d.shape[1] > k + SPARE else np.full(len(q), np.inf)
                row, col = np.nonzero(parts[near] > 0)
                lists_of, times = near[row, col], parts[near[row, col]]
                row, lists_of = np.repeat(row, times), np.repeat(lists_of, times)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(bound[row]), pa.array(lists_of.astype(np.int32)), pa.array(piece.astype(np.int32))], ["query_id", "q", "bound", "list", "piece"])

    asked = fine.where(F.col("vec_id") % every == 0).mapInArrow(ask, "query_id long, q array<double>, bound double, list int, piece int")
    asked = asked.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int"))
    held = indexed.withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.element_at(per_list, F.col("list") + 1)).cast("int"))
    held = held.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        found = scan(model, x.column("vec_id").to_numpy(), matrix(x.column("v"), width), q.column("query_id").to_numpy(), matrix(q.column("q"), width), q.column("bound").to_numpy(), k) if len(x) and len(q) else []
        a, b, c = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(c.astype(float))})

    keys = ("list", "piece", "share")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
