"""Nearest neighbours by a block matrix join in int8, with error bounds, and exact products for what survives.

Queries go out in blocks of a fixed size; each block meets the candidates in tiles. A vector x is kept as s * c with c
of whole numbers from -127 to 127, and e = |x - s c|. Then |q.x - s_q s_x (c_q.c_x)| <= |q| e_x + e_q |s_x c_x|, so a
tile of whole-number products gives lower and upper bounds of all products at once. (The tile's whole numbers pass
through float registers that hold them exactly: numpy has no fast integer product.) Only pairs whose upper bound reaches
the k-th best exact product so far are computed in double precision, and a heap a query keeps the k best of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import column
from lodestone.sources.shared import folder

#: Query vectors in one block, those of them in one tile, and candidates in one tile.
BLOCK, ROWS, TILE = 8192, 512, 1024
#: Numbers in one block's vectors at most: the size bound of what is broadcast.
BLOCK_NUMBERS = 8_000_000
#: Blocks in one job; more blocks are written job by job, so that no plan grows with the queries.
WAVE = 16


def vectors(df: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part: no null or non-finite component, not all zero."""
    ok = F.col(value).isNotNull() & (F.size(value) > 0)
    ok &= ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(value, lambda x: x != 0)
    return df.filter(ok & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(value).cast("array<double>").alias("v"))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (whole numbers up to 127), scale, norm of what the codes stand for, and the error's norm, by row."""
    scale = np.abs(x).max(1) / 127
    codes = np.nan_to_num(np.rint(x / scale[:, None]))  # a scale too small to divide by
    back = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt((back * back).sum(1)), np.sqrt(((x - back) ** 2).sum(1))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Rows:
    """Some queries of one dimension, and their best candidates so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.codes, self.scale, self.back, self.err = quantised(x)
        self.norm = np.sqrt((x * x).sum(1))
        #: Of each query, its best (score, -id) with the worst on top, and that score once there are k.
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    @np.errstate(over="ignore", invalid="ignore", divide="ignore")
    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        codes, scale, back, err = quantised(x)
        # Whole-number products up to 127 * 127 * d are exact in float32 below 2**24, and in float64 at any length here.
        kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
        near = self.codes.astype(kind) @ codes.astype(kind).T
        near = near.astype(np.float64) * self.scale[:, None] * scale[None, :]
        bound = self.norm[:, None] * err[None, :] + self.err[:, None] * back[None, :]
        bound = bound * (1 + 1e-9) + 1e-12 * (1 + np.abs(near))
        # k-th best lower bound of this tile, or the k-th best product so far, whichever is higher
        low, floor = near - bound, self.floor
        other = self.ids[:, None] != ids[None, :]
        if len(ids) > self.k:  # one of them may be the query itself
            sure = np.where(other & np.isfinite(low), low, -np.inf)
            floor = np.maximum(floor, -np.partition(-sure, self.k - 1, axis=1)[:, self.k - 1])
        # what overflows has no bound, so it survives
        q, c = np.nonzero(~(near + bound < floor[:, None]) & other)
        for i in range(0, len(q), 65536):
            exact = product(self.x[q[i : i + 65536]], x[c[i : i + 65536]])
            self._merge(q[i : i + 65536].tolist(), exact, ids[c[i : i + 65536]].tolist())

    def _merge(self, q: list[int], score: np.ndarray, ids: list[int]) -> None:
        for row, x, i in zip(q, np.where(np.isnan(score), -np.inf, score).tolist(), ids, strict=True):
            heap = self.heaps[row]
            if len(heap) < self.k:
                heapq.heappush(heap, (x, -i))
            elif (x, -i) > heap[0]:
                heapq.heapreplace(heap, (x, -i))
            if len(heap) == self.k:
                self.floor[row] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        of = np.repeat(self.ids, [len(h) for h in self.heaps])
        score, ids = [x for h in self.heaps for x, _ in h], [-i for h in self.heaps for _, i in h]
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each dimension in the batch."""
    ids, v = column(batch, "id").to_numpy(), column(batch, "v")
    size, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
    first = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield ids[rows], flat[first[rows][:, None] + np.arange(d)]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product with each query, ties to the smaller id.

    Both tables are (id, v) as vectors() makes them. A candidate with the query's own id does not count, nor do
    vectors of another length than the query's. Queries without candidates give no row; fewer than k candidates give
    all of them. A repeated id counts as often as it occurs among the candidates, and once among the queries, with
    its smallest vector. Products that overflow are infinite; those that have no value (infinite terms of both signs) are
    -infinity.
    """
    spark = candidates.sparkSession
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    size = max(1, min(BLOCK, BLOCK_NUMBERS // max(1, width or 1)))
    n_blocks = max(1, -(-n // size))

    def best(parts: list[DataFrame]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return reduce(DataFrame.unionByName, parts).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def block(b: int) -> DataFrame:  # one pass over the candidates
        table = queries.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toArrow().combine_chunks()
        held = spark.sparkContext.broadcast([(ids, x) for batch in table.to_batches() for ids, x in _matrix(batch)])

        def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [Rows(i[at : at + ROWS], x[at : at + ROWS], k) for i, x in held.value for at in range(0, len(i), ROWS)]
            for batch in batches:
                for ids, x in _matrix(batch):
                    for at in range(0, len(ids), TILE):
                        for own in rows:
                            if own.x.shape[1] == x.shape[1]:
                                own.meet(ids[at : at + TILE], x[at : at + TILE])
            yield from (own.rows() for own in rows)

        return candidates.mapInArrow(tiles, "query_id long, vec_id long, score double")

    if n_blocks <= WAVE:
        return best([block(b) for b in range(n_blocks)])
    path = folder(spark, "nearest")
    for first in range(0, n_blocks, WAVE):
        best([block(b) for b in range(first, min(first + WAVE, n_blocks))]).write.mode("append").parquet(path)
    return spark.read.parquet(path)
