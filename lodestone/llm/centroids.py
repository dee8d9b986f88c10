"""Centroid clustering (Lloyd's rounds) by kd-tree filtering, in whole numbers, so that every result is exact.

Each partition sorts its vectors into kd-trees, once; a node holds a count, the sum of its vectors, the sum of their
squares, and a box. The trees are rows of a table in the shared folder, so a round is one pass over it. In a round the
centroids go down each tree: a centroid that is strictly farther than another one from every point of a node's box is
pruned, a node that keeps one centroid is assigned whole by its count and sums, and a leaf that keeps several is
resolved point by point. Of a partition one row a centroid moves; these are added in two steps, by partition group and
then by centroid, so neither a task nor the driver holds more than a few rows for each centroid.

Whole numbers up to 2**20 go through numpy's registers, which hold all sums and squares of a tree exactly; a tree or
centroids with larger ones go through Python's integers of any length.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, release, save

#: Vectors in one tree and in one of its leaves at most; groups of partitions whose sums are added first.
TREE, LEAF, GROUPS = 16_384, 32, 64
#: Up to this size of components, products and sums of one tree stay below 2**53 a pair and 2**63 a node.
SMALL = 1 << 20
#: A long holds no more.
LONG = (1 << 63) - 1

_PARTIAL = "cluster int, slot int, n long, inertia string, total string"


@dataclass
class Tree:
    """Points in the order of the leaves. Node j has rows first[j] to last[j]; left[j] is -1 for a leaf, else its
    children are left[j] and left[j] + 1."""

    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray
    square: np.ndarray


def vectors(df: DataFrame, width: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(id, v): rows with exactly ``width`` components, none null or not finite."""
    ok = F.col(value).isNotNull() & (F.size(value) == width)
    ok &= ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(ok).select(F.col(key).alias("id"), F.col(value).cast("array<double>").alias("v"))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: small integers where they all are, else Python's."""
    if not x.size or np.abs(x).max() <= SMALL / scale:
        return np.floor(x * scale).astype(np.int32)
    out = np.empty(x.shape, object)
    out.flat = [math.floor(y * scale) if abs(y) < 1e300 else int(y) * scale for y in x.ravel().tolist()]
    return out


def build(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree that halves the widest side of each box, and the order in which it took the points."""
    order, first, last, left = np.arange(len(points)), [0], [len(points)], []
    low, high = [points.min(0)], [points.max(0)]
    while len(left) < len(first):
        j = len(left)
        a, b, side = first[j], last[j], high[j] - low[j]
        axis = int(np.argmax(side))
        if b - a <= LEAF or side[axis] == 0:
            left.append(-1)
            continue
        left.append(len(first))
        by = np.argsort(points[order[a:b], axis], kind="stable")
        order[a:b], middle = order[a:b][by], (a + b) // 2
        for c, d in ((a, middle), (middle, b)):
            rows = points[order[c:d]]
            first.append(c), last.append(d), low.append(rows.min(0)), high.append(rows.max(0))
    kind = object if points.dtype == object else np.int64
    points = points[order]
    wide = points.astype(kind)
    total, square = (np.concatenate([np.zeros((1, *x.shape[1:]), kind), np.cumsum(x, 0)]) for x in (wide, (wide * wide).sum(1)))
    at, to = np.array(first), np.array(last)
    return Tree(points, at, to, np.array(left), np.array(low), np.array(high), total[to] - total[at], square[to] - square[at]), order


def descend(tree: Tree, centers: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """((node, centroid) assigned whole), rows of the leaves that keep several centroids, and those rows' centroids left."""
    kind = object if tree.points.dtype == object or centers.dtype == object else np.int64
    centers = centers.astype(kind)
    nodes, alive = np.zeros(1, int), np.ones((1, len(centers)), bool)
    done, rows, left = [], [np.zeros(0, int)], [np.zeros((0, len(centers)), bool)]
    while len(nodes):
        low, high = tree.low[nodes].astype(kind)[:, None], tree.high[nodes].astype(kind)[:, None]
        off = low + high - 2 * centers
        far = (off * off).sum(2)
        near = np.where(alive, far, far.max() + 1).argmin(1)
        own = centers[near][:, None]
        # of all points of the box, this corner favours the other centroid most
        step = centers - own
        ahead = (step * (centers + own - 2 * np.where(step > 0, high, low))).sum(2)
        alive &= ~(ahead > 0).astype(bool)
        one, leaf = alive.sum(1) == 1, tree.left[nodes] < 0
        done += zip(nodes[one].tolist(), alive[one].argmax(1).tolist(), strict=True)
        for j, keep in zip(nodes[leaf & ~one].tolist(), alive[leaf & ~one], strict=True):
            rows.append(np.arange(tree.first[j], tree.last[j]))
            left.append(np.repeat(keep[None], len(rows[-1]), 0))
        down = ~leaf & ~one
        nodes, alive = np.repeat(tree.left[nodes[down]], 2), np.repeat(alive[down], 2, 0)
        nodes[1::2] += 1
    return done, np.concatenate(rows), np.concatenate(left)


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centroids, exactly."""
    kind = object if points.dtype == object or centers.dtype == object else np.float64
    x, c = points.astype(kind), centers.astype(kind)
    out = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    return out if kind is object else out.astype(np.int64)


def resolve(tree: Tree, rows: np.ndarray, left: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row among those left, ties to the smaller number, and the squared distance."""
    if not len(rows):
        return np.zeros(0, int), np.zeros(0, np.int64)
    d = distances(tree.points[rows], centers)
    d = np.where(left, d, d.max() + 1)
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


def assigned(tree: Tree, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each point of the tree."""
    done, rows, left = descend(tree, centers)
    of, far = np.zeros(len(tree.points), int), np.zeros(len(tree.points), object)
    of[rows], far[rows] = resolve(tree, rows, left, centers)
    for j, z in done:
        part = slice(tree.first[j], tree.last[j])
        of[part], far[part] = z, distances(tree.points[part], centers[z : z + 1])[:, 0]
    return of, far


class Sums:
    """Count, sum of distances and sum of vectors of each centroid, in Python's integers."""

    def __init__(self, k: int, width: int) -> None:
        self.n, self.inertia, self.total = [0] * k, [0] * k, np.zeros((k, width), object)

    def add(self, tree: Tree, centers: np.ndarray) -> None:
        done, rows, left = descend(tree, centers)
        own = [[int(x) for x in c] for c in centers]
        for j, z in done:
            n, total = int(tree.last[j] - tree.first[j]), [int(x) for x in tree.total[j]]
            self.n[z] += n
            self.total[z] += total
            self.inertia[z] += int(tree.square[j]) - sum(2 * a * b - n * b * b for a, b in zip(total, own[z], strict=True))
        of, far = resolve(tree, rows, left, centers)
        for z in np.unique(of).tolist():
            mine = of == z
            part = tree.points[rows[mine]]
            self.n[z] += int(mine.sum())
            self.total[z] += part.sum(0, dtype=part.dtype if part.dtype == object else np.int64).astype(object)
            self.inertia[z] += sum(far[mine].tolist())


def centers_of(rows: list[list[int]]) -> np.ndarray:
    out = np.array(rows, object)
    return out.astype(np.int64) if out.size and max(map(abs, out.flat)) <= SMALL else out


def trees(rows: DataFrame, scale: int) -> DataFrame:
    """(ids, tree): the vectors of each partition as kd-trees of bounded size, written to the shared folder."""

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def tree() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            v = table["v"].combine_chunks()
            points, ids = whole(v.flatten().to_numpy().reshape(len(v), -1), scale), table["id"].combine_chunks()
            made, order = build(points)
            if made.points.dtype != object and np.abs(made.points).max() < 1 << 15:
                made.points = made.points.astype(np.int16)
            row = ids.take(pa.array(order))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row), pa.array([pickle.dumps(made)], pa.binary())], names=["ids", "tree"])

        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                if n + part.num_rows > TREE:
                    yield tree()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield tree()
        release()

    kind = dict(rows.dtypes)["id"]
    return save(rows.mapInArrow(planted, f"ids array<{kind}>, tree binary"), "trees")


def _added(rows: pa.Table) -> pa.Table:
    total = np.zeros(1, object)
    for text in rows["total"].to_pylist():
        total = total + np.array(json.loads(text), object)
    n, inertia = sum(rows["n"].to_pylist()), sum(int(x) for x in rows["inertia"].to_pylist())
    return pa.table({"cluster": rows["cluster"][:1], "slot": pa.array([0], pa.int32()), "n": [n], "inertia": [str(inertia)], "total": [json.dumps(total.tolist())]})


def sums(forest: DataFrame, centers: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """By centroid: how many vectors are nearest to it, the sum of their squared distances and their sum."""
    k, width = centers.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, slot = Sums(k, width), TaskContext.get().partitionId() % GROUPS
        for batch in batches:
            for tree in column(batch, "tree"):
                out.add(pickle.loads(tree.as_py()), centers)
        own = [z for z in range(k) if out.n[z]]
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(own, pa.int32()), "slot": pa.array([slot] * len(own), pa.int32()), "n": pa.array([out.n[z] for z in own], pa.int64())}
            | {"inertia": pa.array([str(out.inertia[z]) for z in own], pa.string()), "total": pa.array([json.dumps(out.total[z].tolist()) for z in own], pa.string())}
        )

    parts = forest.select("tree").mapInArrow(partial, _PARTIAL)
    added = parts.groupBy("cluster", "slot").applyInArrow(_added, _PARTIAL).groupBy("cluster").applyInArrow(_added, _PARTIAL)
    return {r["cluster"]: (r["n"], int(r["inertia"]), json.loads(r["total"])) for r in added.collect()}


def cluster(rows: DataFrame, k: int, rounds: int, width: int, first: Column, scale: int = 1024) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): ``rounds`` of Lloyd's algorithm, then an assignment.

    rows: (id, v) as vectors() makes them, all of ``width`` components; component x counts as floor(scale * x).
    first: the k rows smallest in it are the first centroids, in its order (nulls last, ties by vector); fewer rows give
    fewer centroids. Each vector belongs to the nearest centroid, ties to the smaller number. A centroid with vectors
    becomes the componentwise floor of their mean; one without stays. centroid is the final one's components as decimals.

    A null id is an id like others. Repeated rows count as often as they occur. distance and the two sums are null where
    they exceed a long. No rows give no rows. Extra columns do not matter, since vectors() selects its own.
    """
    spark = rows.sparkSession
    forest = trees(rows, scale)
    # k rows: what the driver holds
    seeds = rows.select(first.alias("_by"), "v").orderBy(F.col("_by").asc_nulls_last(), "v").limit(k).collect()
    schema = f"id {dict(rows.dtypes)['id']}, cluster int, distance long, cluster_inertia long, inertia long, centroid string"
    if not seeds:
        return spark.createDataFrame([], schema)
    centers = centers_of([whole(np.array([r["v"]], np.float64), scale)[0].tolist() for r in seeds])
    for _ in range(rounds):
        found = sums(forest, centers)
        moved = centers_of([[x // found[z][0] for x in found[z][2]] if z in found else list(map(int, c)) for z, c in enumerate(centers)])
        if np.array_equal(moved, centers):  # all further rounds would give the same
            break
        centers = moved
    found = sums(forest, centers)
    fits = lambda x: x if x <= LONG else None
    of = [fits(found[z][1]) if z in found else 0 for z in range(len(centers))]
    inertia, texts = fits(sum(x for _, x, _ in found.values())), [",".join(map(str, c)) for c in centers.tolist()]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in zip(column(batch, "ids"), column(batch, "tree"), strict=True):
                own, far = assigned(pickle.loads(tree.as_py()), centers)
                own = own.tolist()
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(own, pa.int32()), pa.array(list(map(fits, map(int, far))), pa.int64()), pa.array([of[z] for z in own], pa.int64())]
                    + [pa.array([inertia] * len(own), pa.int64()), pa.array([texts[z] for z in own], pa.string())],
                    names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"],
                )
        release()

    return forest.mapInArrow(labelled, schema)
