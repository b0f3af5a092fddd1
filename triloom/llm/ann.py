"""Nearest neighbours by largest inner product with an inverted multi-index.

The two halves of the vectors are quantised separately, with ``CENTROIDS`` centroids each up to some four million vectors
and by the root of their number beyond, ``MOST_CENTROIDS`` at most; a pair of centroids is a cell. A query walks the pairs by falling sum of its halves' products with the centroids, with a heap (the
multi-sequence walk), until the cells hold the share of all vectors that the fit found necessary, and reranks their
entries with exact products in double precision.

The fit reads at most about ``SAMPLE`` vectors: k-means for both halves, then the smallest share of the sample whose cells
hold ``target`` of the sample queries' true neighbours. Everything else covers all rows. Work is dealt in blocks: cells are
packed into blocks of about ``BLOCK_BYTES`` (a larger cell is split by a hash of the id), and queries, in the order of
their own cells, into groups of ``QUERY_BYTES``, so that a group's queries walk much the same cells. A block is sent to those groups only
that visit it; a pair of block and group is one task's work and returns at most k rows a query. Where vectors have no
structure every group visits about half of all blocks, and the work grows with vectors times queries, as no index can avoid;
the fitted ``share`` tells.

Defined results: a vector that is null, zero, or has null or non-finite components, a row without id, and a vector whose
length is not the sample's commonest take no part. Repeated rows are separate candidates, but one query (of several vectors
under one id the first by its bytes); the query's own id is never its neighbour. Fewer candidates than k give all of them, if
they lie in the walked cells; the walk covers k + 1 vectors at least. Columns of doubles are compared as doubles. An
empty table gives an empty result. Intermediate tables are deleted, but for the result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import Scratch, materialise

CENTROIDS, MOST_CENTROIDS = 64, 512
SAMPLE = 16_384
CALIBRATION = 200
BLOCK_BYTES, QUERY_BYTES = 1 << 21, 1 << 20


def valid(vector):
    """Whether a float array takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    if not x.shape[1]:  # the right half of one-component vectors
        return np.zeros((1, 0))
    rng = np.random.default_rng(5)
    distinct = np.unique(x, axis=0)
    centers = distinct[rng.permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, centers)
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centers))
        centers[n > 0] = total[n > 0] / n[n > 0][:, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1)[None, :] - 2 * (x @ centers.T)).argmin(axis=1)


def half_of(dim: int) -> int:
    return max(1, dim // 2)


@dataclass
class MultiIndex:
    dim: int
    left: np.ndarray
    right: np.ndarray
    share: float = 1.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = half_of(self.dim)
        return nearest(x[:, :half], self.left) * len(self.right) + nearest(x[:, half:], self.right)

    def walk(self, q: np.ndarray, counts: np.ndarray, need: int):
        """Cells by falling sum of the halves' products, until they hold ``need`` vectors."""
        half = half_of(self.dim)
        a, b = self.left @ q[:half], self.right @ q[half:]
        i, j = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b, wide = a.tolist(), b.tolist(), len(self.right)
        heap, next_j, got = [(-a[i[0]] - b[j[0]], 0, 0)], [0] * len(i), 0
        size = counts.tolist()
        while heap and got < need:
            _, x, y = heapq.heappop(heap)
            cell = i[x] * wide + j[y]
            got += size[cell]
            yield cell
            if y + 1 < len(j):
                heapq.heappush(heap, (-a[i[x]] - b[j[y + 1]], x, y + 1))
            if y == 0 and x + 1 < len(i):
                heapq.heappush(heap, (-a[i[x + 1]] - b[j[0]], x + 1, 0))


def fit(vectors: DataFrame, target: float = 0.96, k: int = 20, centroids: int | None = None) -> MultiIndex | None:
    """``vectors`` is (vec_id, v) with valid rows; None where there are none."""
    total = vectors.count()
    if not total:
        return None
    scale = 1 << 30
    picked = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(scale)) < int(scale * min(1.0, SAMPLE / total))).toArrow()
    if not picked.num_rows:
        picked = vectors.limit(1).toArrow()
    lists = picked.sort_by("vec_id")["v"].to_pylist()
    dim = Counter(map(len, lists)).most_common(1)[0][0]
    x = np.array([v for v in lists if len(v) == dim], np.float64)
    centroids = centroids or min(MOST_CENTROIDS, max(CENTROIDS, int(total**0.5) // 32))
    index = MultiIndex(dim, kmeans(x[:, : half_of(dim)], centroids), kmeans(x[:, half_of(dim) :], centroids))
    cell = index.cells(x)
    counts = np.bincount(cell, minlength=len(index.left) * len(index.right))
    shares = []
    for n in np.random.default_rng(7).permutation(len(x))[:CALIBRATION]:
        s = x @ x[n]
        s[n] = -np.inf
        top = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
        place = np.full(len(counts), len(x))
        got = 0
        for c in index.walk(x[n], counts, len(x)):
            got += counts[c]
            place[c] = got
        shares.extend(place[cell[top]] / len(x))
    index.share = float(min(1.0, np.quantile(shares, target) + 0.01)) if shares else 1.0
    return index


def packed(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first box of each cell and the number of boxes it has, for boxes of about ``most``, and the number of boxes."""
    first, parts, box, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for c in np.flatnonzero(counts):
        if held and held + counts[c] > most:
            box, held = box + 1, 0
        first[c], parts[c] = box, max(1, -(-counts[c] // most))
        held += counts[c]
        if parts[c] > 1:
            box, held = box + parts[c], 0
    return first, parts, box + 1


def search(table: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, index: MultiIndex | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that the Column ``queries`` marks."""
    spark, scratch = table.sparkSession, Scratch()
    schema = "query_id long, rank int, vec_id long, score double"
    narrow = isinstance(getattr(table.schema[vector_col].dataType, "elementType", None), T.FloatType)
    kind = np.dtype(np.float32 if narrow else np.float64)
    given = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("v"), queries.alias("asked"))
    given = given.where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    index = index or fit(given.select("vec_id", "v"), k=k)
    if index is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(index)
    dim = index.dim

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim).astype(np.float64)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), kind).reshape(batch.num_rows, dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2), pa.array(shared.value.cells(x.astype(np.float64)), pa.int32())], names=["vec_id", "v", "asked", "cell"])

    rows = scratch.keep(given.where(F.size("v") == dim).select("vec_id", "v", F.coalesce("asked", F.lit(False)).alias("asked")).mapInArrow(placed, "vec_id long, v binary, asked boolean, cell int"), "cells")
    counts, asked_counts = np.zeros((2, len(index.left) * len(index.right)), np.int64)
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).collect():  # at most MOST_CENTROIDS**2 rows
        counts[r["cell"]], asked_counts[r["cell"]] = r["n"], r["asked"]
    need = max(k + 1, int(np.ceil(index.share * counts.sum())))
    vector_bytes = dim * kind.itemsize
    first, parts, _ = packed(counts, max(256, BLOCK_BYTES // vector_bytes))
    group, groups, _ = packed(asked_counts, max(256, QUERY_BYTES // vector_bytes))
    plan = spark.createDataFrame([(int(c), int(first[c]), int(parts[c]), int(group[c]), int(groups[c])) for c in np.flatnonzero(counts)] or [], "cell int, first long, parts long, group long, groups long")

    def walked(batches):
        for batch in batches:
            if batch.num_rows:
                bits, blocks = [], []
                for q in matrix(batch.column(1)):
                    seen = np.zeros(len(counts), bool)
                    seen[list(shared.value.walk(q, counts, need))] = True
                    seen &= counts > 0
                    bits.append(np.packbits(seen).tobytes())
                    hit = np.flatnonzero(seen)
                    blocks.append(np.unique(np.concatenate([first[hit], *[np.arange(first[c], first[c] + parts[c]) for c in hit[parts[hit] > 1]]])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(bits, pa.binary()), pa.array(blocks, pa.list_(pa.int64()))], names=["query_id", "q", "part", "seen", "blocks"])

    asked = rows.where("asked").groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("own")).select("vec_id", "own.v", "own.cell")
    asked = asked.join(F.broadcast(plan), "cell").select("vec_id", "v", (F.col("group") + F.pmod(F.xxhash64("vec_id"), F.col("groups"))).alias("part")).repartition(spark.sparkContext.defaultParallelism)
    walks = scratch.keep(asked.mapInArrow(walked, "query_id long, q binary, part long, seen binary, blocks array<long>"), "walks")
    visits = walks.select("part", F.explode("blocks").alias("block"))
    held_by = rows.join(F.broadcast(plan), "cell").select("vec_id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"))
    # the groups that visit a block: as many longs at most as there are groups
    visitors = visits.distinct().groupBy("block").agg(F.collect_list("part").alias("visitors"))
    dealt = held_by.join(visitors, "block").select("vec_id", "v", "cell", "block", F.explode("visitors").alias("part"))

    def reranked(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, qs = matrix(right["v"]), matrix(left["q"])
            ids, cell = right["vec_id"].to_numpy(), right["cell"].to_numpy()
            seen = np.frombuffer(b"".join(left["seen"].to_pylist()), np.uint8).reshape(len(qs), -1)
            slack = 8 * dim * np.finfo(np.float64).eps * np.abs(x).max() * np.abs(qs).max()
            for lo in range(0, len(qs), 64):
                products = qs[lo : lo + 64] @ x.T
                for query, q, bits, rough in zip(left["query_id"].to_pylist()[lo : lo + 64], qs[lo:], seen[lo:], products, strict=False):
                    at = np.flatnonzero((bits[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool) & (ids != query))
                    if not len(at):
                        continue
                    if len(at) > k:
                        rough = rough[at]
                        at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - dim * slack]
                    exact = (x[at] * q).sum(axis=1)  # row by row, so that equal vectors get equal scores
                    best = np.lexsort((ids[at], -exact))[:k]
                    out.extend((query, int(ids[at][b]), float(exact[b])) for b in best)
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    met = walks.select("query_id", "q", "seen", "part", F.explode("blocks").alias("block"))
    found = met.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(reranked, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    result = materialise(ranked, "nearest")
    scratch.clear()
    return result
