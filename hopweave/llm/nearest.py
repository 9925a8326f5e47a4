"""Exact nearest neighbours by inner product, as a block matrix join.

Queries and candidates are dealt into blocks, and each pair of blocks is one cell of the product. In a cell the
vectors are rounded to 8-bit integers with a scale of their own; the integer product of a tile, with a bound on what
rounding can have changed, gives a lower and an upper bound of each inner product. Only pairs whose upper bound
reaches the query's k-th best so far are computed again from the original vectors, in double precision and in the
order of components, and go into the query's heap of k, which is carried from tile to tile; the cells' heaps are merged.
Vectors with a largest component beyond 2**300 or under 2**-300 have no bounds: all their pairs are computed again.

Rows that are the same in id and vector are counted before they are dealt, and vectors of one id are dealt apart, so
none of them makes a large cell.

Nulls and the like: vectors that are null, empty, zero or hold null or non-finite components take no part, and
neither do rows with a null vec_id; vectors of different lengths are not compared; a query is not its own neighbour,
nor are rows that repeat its vec_id; a vec_id in several query rows asks once, with the smallest of their vectors;
other repeated rows are neighbours each; ties go to the smaller vec_id; a product that overflows to no number is left
out; with fewer than k candidates all are returned; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop, kept

K, QUERY_BLOCK, CANDIDATE_BLOCK = 20, 8192, 16384
TILE = 1024
OUT = "query_id long, vec_id long, score double"


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


class Rounded:
    """Vectors as 8-bit integers, with what rounding lost; `wild` ones have none."""

    def __init__(self, x: np.ndarray):
        self.x = x
        most = np.abs(x).max(axis=1)
        self.wild = (most > 2.0**300) | (most < 2.0**-300)
        tame = np.where(self.wild[:, None], 1.0, x)
        self.scale = np.abs(tame).max(axis=1) / 127
        self.ints = np.rint(tame / self.scale[:, None]).astype(np.int8)
        near = self.ints * self.scale[:, None]
        self.near, self.lost, self.norm = (np.linalg.norm(v, axis=1) for v in (near, tame - near, tame))

    def factor(self) -> np.ndarray:
        """The integers in a form whose products are exact and fast: sums of up to 1,000 products of theirs fit float32."""
        return self.ints.astype(np.float32 if self.ints.shape[1] <= 1000 else np.float64)


def bounds(q: Rounded, c: Rounded) -> tuple[np.ndarray, np.ndarray]:
    """The inner products of the rounded vectors, and how far from them the true ones may be."""
    near = (q.factor() @ c.factor().T).astype(np.float64) * q.scale[:, None] * c.scale[None, :]
    slack = (np.outer(q.lost, c.norm) + np.outer(q.near, c.lost)) * (1 + 1e-9) + np.outer(q.norm, c.norm) * 1e-12
    slack[q.wild] = np.inf
    slack[:, c.wild] = np.inf
    return near, slack


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
    return total


def block_product(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest candidates of each query: rows of (query, candidate, score)."""
    tiles = [(Rounded(c[b : b + TILE]), cid[b : b + TILE]) for b in range(0, len(c), TILE)]
    out = []
    for a in range(0, len(q), TILE):
        rq, ids = Rounded(q[a : a + TILE]), qid[a : a + TILE]
        # the worst of a heap is first: the smallest score, of equal ones the largest id
        heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        floor = np.full(len(ids), -np.inf)
        for rc, cids in tiles:
            near, slack = bounds(rq, rc)
            own = ids[:, None] == cids[None, :]
            low = np.where(own, -np.inf, near - slack)
            if len(cids) >= k:
                floor = np.maximum(floor, np.partition(low, len(cids) - k, axis=1)[:, len(cids) - k])
            row, col = np.nonzero((near + slack >= floor[:, None]) & ~own)
            for r, score, other in zip(row.tolist(), _exact(rq.x[row], rc.x[col]).tolist(), (-cids[col]).tolist(), strict=True):
                heap = heaps[r]
                if len(heap) < k:
                    if score == score:
                        heapq.heappush(heap, (score, other))
                elif (score, other) > heap[0]:
                    heapq.heapreplace(heap, (score, other))
            floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
        out += [(i, -other, score) for i, heap in zip(ids.tolist(), heaps, strict=True) for score, other in heap]
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return np.array(cols[0], dtype=np.int64), np.array(cols[1], dtype=np.int64), np.array(cols[2], dtype=np.float64)


def _cell(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        made = []
        # as many of equal rows as can be among the nearest
        every = np.repeat(np.arange(candidates.num_rows), np.minimum(candidates.column("copies").to_numpy(), k))
        both = [(t.column("vec_id").to_numpy(), t.column("v").combine_chunks()) for t in (queries, candidates.take(pa.array(every)))]
        sizes = [v.value_lengths().to_numpy() for _, v in both]
        for n in np.intersect1d(*(np.unique(s) for s in sizes)).tolist() if all(map(len, sizes)) else []:
            part = [(i[s == n], v.filter(pa.array(s == n)).flatten().to_numpy().astype(np.float64).reshape(-1, n)) for (i, v), s in zip(both, sizes, strict=True)]
            made.append(block_product(*part[0], *part[1], k))
        cols = [np.concatenate(x) for x in zip(*made, strict=True)] if made else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(x) for x in cols], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k nearest other rows of each query row: query_id, rank (from 1), vec_id, score."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    good = good.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"), F.max("is_query").alias("is_query"))
    good, good_at = kept(good, "vectors")
    n, asked = good.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    rows, columns = -(-asked // query_block) or 1, -(-n // candidate_block) or 1
    dealt = good.withColumn("block", F.xxhash64("vec_id", "v"))
    asking = dealt.where("is_query").groupBy("vec_id").agg(F.min(F.struct("v", "block")).alias("q")).select("vec_id", "q.v", "q.block")
    queries = asking.select("vec_id", "v", F.pmod("block", F.lit(rows).cast("long")).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("c"))
    candidates = dealt.select("vec_id", "v", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("r"), F.pmod("block", F.lit(columns).cast("long")).alias("c"))
    cells = queries.groupBy("r", "c").cogroup(candidates.groupBy("r", "c")).applyInArrow(_cell(k), OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cells, _ = kept(cells, "cells")
    drop(vectors.sparkSession, good_at)
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
