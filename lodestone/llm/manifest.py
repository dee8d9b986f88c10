"""Merkle manifest of a dataset: one tree per source, one tree over the sources' roots, a proof for every row.

Leaves are digests that Spark makes of each row. They are sorted by source and key across partitions, in which they get
their places: only the first and last source of a partition can reach beyond it, so one small row a partition says where
each source starts, how many leaves it has and how many sources there are, and with that how many children every node
has. A partition then folds its leaves into a sparse forest: whenever all children of a node are there, they become the
node, and what cannot be resolved stays, keyed by tree, level and place. Forests form a monoid (put two together and
fold again, in any grouping), so treeReduce merges the partitions' forests into one, whose only node is the root.

The proofs need the siblings of every node on a leaf's path. Families of children that a partition has whole it finds
again by itself. Those that only came together in a merge are kept beside the forest: a partition has two such
families a level at most, and higher levels have ever fewer, so they take a few KB for each partition of the sorted
leaves, however many rows there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, release, save

#: Children of a node at most.
ARITY = 16
#: Sorted leaves in one partition, about: their rows have some 200 bytes. Most partitions of the sort.
ROWS, PARTS = 50_000, 20_000
#: The tree over the sources' roots; the trees of sources have the source's number.
TOP = -1
#: Key of a node: tree, level, place.
Node = tuple[int, int, int]


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: of each column `-` if null, else its UTF-8 byte count, a colon, its value (as text)."""
    text = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*text), 256)


def digest(children: Iterable[bytes]) -> bytes:
    """The node over these children: sha256 of their digests as hex text."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


class Sizes:
    """How many nodes each level of each tree has: of the sources of a few partitions, and of the tree over sources."""

    def __init__(self, leaves: dict[int, int], sources: int) -> None:
        self.leaves = leaves | {TOP: sources}

    def width(self, tree: int, level: int) -> int:
        return -(-self.leaves[tree] // ARITY**level)

    def parent(self, node: Node) -> Node | None:
        """The node above; of a source's root the place in the tree over sources; None above the root of all."""
        tree, level, place = node
        if self.width(tree, level) > 1:
            return tree, level + 1, place // ARITY
        return None if tree == TOP else (TOP, 0, tree)

    def family(self, node: Node) -> range:
        """Places of the node's siblings, its own included; a root stands alone."""
        width = self.width(*node[:2])
        first = node[2] // ARITY * ARITY
        return range(first, min(first + ARITY, width))


class Forest:
    """Unresolved nodes, and the families that came together in a merge (all digests of one, left to right).

    ``trees`` has the leaf counts of the trees whose nodes are not resolved; others are done with.
    """

    def __init__(self, sources: int, trees: dict[int, int], nodes: dict[Node, bytes] | None = None) -> None:
        self.sources, self.trees, self.nodes = sources, trees, nodes or {}
        self.families: dict[Node, list[bytes]] = {}

    def fold(self, keep: bool) -> Forest:
        """Replace families that are whole by their parents, level by level; ``keep`` notes them."""
        sizes, due = Sizes(self.trees, self.sources), list(self.nodes)
        while due:
            above = []
            for node in due:
                if node not in self.nodes or (up := sizes.parent(node)) is None:
                    continue
                tree, level, _ = node
                if up[:2] == (TOP, 0) and tree != TOP:  # a source's root enters the tree over sources as it is
                    self.nodes[up] = self.nodes.pop(node)
                elif all((tree, level, i) in self.nodes for i in sizes.family(node)):
                    children = [self.nodes.pop((tree, level, i)) for i in sizes.family(node)]
                    self.nodes[up] = digest(children)
                    if keep:
                        self.families[tree, level, node[2] // ARITY] = children
                else:
                    continue
                above.append(up)
            due = above
        open_trees = {tree for tree, _, _ in self.nodes}
        self.trees = {t: n for t, n in self.trees.items() if t in open_trees}
        return self

    def merge(self, other: Forest) -> Forest:
        """Both together, folded again: associative, and the order does not matter."""
        both = Forest(max(self.sources, other.sources), self.trees | other.trees, self.nodes | other.nodes)
        both.families = self.families | other.families
        return both.fold(keep=True)


class Layout:
    """Where the sources of each sorted partition stand: from one row a partition, by the driver."""

    def __init__(self, parts: list[tuple[int, int, int, int, bool]]) -> None:
        """parts: (partition, its sources, leaves of its first source, of its last one, whether its first source is the
        last of the partition before), in order, of partitions with rows."""
        self.of: dict[int, tuple[int, int, int, int]] = {}
        number, before, starts = -1, 0, []
        for part, sources, head, tail, goes_on in parts:
            if not goes_on:
                number, before = number + 1, 0
            starts.append((part, number, before, sources))
            number, before = number + sources - 1, (before + head if sources == 1 else tail)
        self.sources = number + 1
        # leaves of sources that reach beyond their partition, from the last partition back
        rest: dict[int, int] = {}
        for (_, first, _, n), (_, _, head, tail, _) in zip(starts, parts, strict=True):
            rest[first] = rest.get(first, 0) + head
            if n > 1:
                rest[first + n - 1] = rest.get(first + n - 1, 0) + tail
        for part, first, offset, n in starts:
            self.of[part] = (first, offset, rest[first], rest[first + n - 1])

    def places(self, part: int, sources: list[int], local: list[int]) -> tuple[list[tuple[int, int]], dict[int, int]]:
        """(tree, place) of the partition's rows, and the leaf counts of its trees. sources, local: numbers of a row's
        source in the partition and of the row in that part of the source, both from 0, in order."""
        first, offset, head, tail = self.of[part]
        out = [(first + s, i + (offset if s == 0 else 0)) for s, i in zip(sources, local, strict=True)]
        trees: dict[int, int] = {}
        for tree, i in out:
            trees[tree] = i + 1
        trees[first + sources[-1]] = tail
        trees[first] = head
        return out, trees


def sorted_leaves(rows: DataFrame, parts: int) -> DataFrame:
    """rows (key, source, leaf, other) sorted by source and key over ``parts`` partitions, each row with the number of its
    partition, of its source in there, and of the row in that part of the source; written to the shared folder."""
    by = [F.col("source").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    # rows that are equal in all else are told apart by tie, so that range partitions can split them; which of them
    # gets which place does not matter
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("tie")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, source, at, i = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            numbers, places = [], []
            for name in column(batch, "source").to_pylist():
                if at < 0 or name != source:
                    source, at, i = name, at + 1, 0
                numbers.append(at)
                places.append(i)
                i += 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "own", "place"])

    kinds = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
    return save(dealt.mapInArrow(numbered, f"{kinds}, part int, own long, place long"), "leaves")


def layout(leaves: DataFrame) -> Layout:
    ends = leaves.groupBy("part").agg(F.min(F.struct("own", "source")).alias("a"), F.max(F.struct("own", "source")).alias("z"))
    sizes = leaves.groupBy("part", "own").agg(F.count("*").alias("n"))
    only = sizes.join(ends, "part").groupBy("part").agg(
        F.max(F.when(F.col("own") == 0, F.col("n"))).alias("head"), F.max(F.when(F.col("own") == F.col("z.own"), F.col("n"))).alias("tail"), F.first("a").alias("a"), F.first("z").alias("z")
    )
    parts, last = [], None
    for r in only.orderBy("part").collect():  # one row a partition
        parts.append((r["part"], r["z"]["own"] + 1, r["head"], r["tail"], last is not None and last == (r["a"]["source"],)))
        last = (r["z"]["source"],)
    return Layout(parts)


Step = tuple[list[str], int]


def paths(places: list[tuple[int, int]], trees: dict[int, int], leaves: list[str], sources: int, families: dict[Node, list[bytes]]) -> Iterator[tuple[str, str, tuple[Step, ...]]]:
    """Of each leaf of a partition: its source's root, the root, and (family, place in it) level by level up to the root.

    families: all those that no partition has whole. Digests are hex text here.
    """
    sizes = Sizes(trees, sources)
    nodes = {(tree, 0, i): x for (tree, i), x in zip(places, leaves, strict=True)}
    known: dict[Node, list[str]] = {}

    def family(node: Node) -> list[str]:
        key = (node[0], node[1], node[2] // ARITY)
        if key not in known:
            known[key] = [x.hex() for x in families[key]] if key in families else [nodes[node[0], node[1], i] for i in sizes.family(node)]
        return known[key]

    # the sources' trees first: their roots, which stand at various heights, are the leaves of the tree over sources
    for level, tops in ((dict(nodes), False), ({}, True)):
        if tops:
            level = {n: x for n, x in nodes.items() if n[0] == TOP}
        while level:
            above: dict[Node, str] = {}
            for node, x in level.items():
                up = sizes.parent(node)
                if up is None or up in above:
                    continue
                if node[0] != TOP and up[0] == TOP:
                    nodes[up] = x
                else:
                    above[up] = sha256("".join(family(node)).encode()).hexdigest()
            nodes |= above
            level = above
    memo: dict[Node, tuple[str, str, tuple[Step, ...]]] = {}

    def above_of(node: Node) -> tuple[str, str, tuple[Step, ...]]:
        """(root of the node's tree, root of all, steps) from a node, which its descendants share."""
        if node not in memo:
            up = sizes.parent(node)
            if up is None:
                memo[node] = nodes[node], nodes[node], ()
            elif node[0] != TOP and up[0] == TOP:
                memo[node] = nodes[node], *above_of(up)[1:]
            else:
                own, root, steps = above_of(up)
                memo[node] = own, root, ((family(node), node[2] % ARITY), *steps)
        return memo[node]

    for tree, i in places:
        yield above_of((tree, 0, i))


def proved(steps: tuple[Step, ...], x: str) -> tuple[str, str]:
    """sha256 over the siblings' digests, and the root folded from x and the siblings."""
    siblings = sha256()
    for family, at in steps:
        left, right = "".join(family[:at]), "".join(family[at + 1 :])
        siblings.update((left + right).encode())
        x = sha256((left + x + right).encode()).hexdigest()
    return siblings.hexdigest(), x


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", by: str = "source", other: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root): a Merkle tree per ``by``, and one over their roots.

    A leaf is the digest of ``columns``. The leaves of one source ascend by key (nulls first); the roots of the sources
    ascend by source (null first, bytewise). Of each row, ``folded_root`` is the root that its leaf and the siblings give;
    ``other`` is a leaf to fold in its place where it is not null (to test what a change would give).

    Rows with equal keys stand in the order of their leaves, and equal leaves take neighbouring places. Nulls in any
    column and empty texts have leaves of their own; extra columns do not matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(by).alias("source"), leaf([F.col(c) for c in columns]).alias("leaf"), (F.lit(None).cast("string") if other is None else other).alias("other"))
    rows = save(rows, "digests")
    parts = max(1, min(PARTS, -(-rows.count() // ROWS)))
    leaves = sorted_leaves(rows, parts)
    where = layout(leaves)

    def forests(t: pa.Table) -> pa.Table:
        t, part = t.sort_by([("own", "ascending"), ("place", "ascending")]), t["part"][0].as_py()
        places, trees = where.places(part, t["own"].to_pylist(), t["place"].to_pylist())
        nodes = {(tree, 0, i): bytes.fromhex(x) for (tree, i), x in zip(places, t["leaf"].to_pylist(), strict=True)}
        return pa.table({"forest": [pickle.dumps(Forest(where.sources, trees, nodes).fold(keep=False))]})

    kind = f"key {dict(rows.dtypes)['key']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    if not where.of:
        return spark.createDataFrame([], kind)
    own = leaves.select("part", "own", "place", "leaf").groupBy("part").applyInArrow(forests, "forest binary")
    whole = own.rdd.map(lambda r: pickle.loads(r["forest"])).treeReduce(Forest.merge)
    families = spark.sparkContext.broadcast(whole.families)

    def proofs(t: pa.Table) -> pa.Table:
        t, part = t.sort_by([("own", "ascending"), ("place", "ascending")]), t["part"][0].as_py()
        places, trees = where.places(part, t["own"].to_pylist(), t["place"].to_pylist())
        leaf, other = t["leaf"].to_pylist(), t["other"].to_pylist()
        out: list[tuple[str, ...]] = []
        for x, y, (subroot, root, steps) in zip(leaf, other, paths(places, trees, leaf, where.sources, families.value), strict=True):
            out.append((subroot, root, *proved(steps, x if y is None else y)))
        names = ("subroot", "root", "proof_sha256", "folded_root")
        return pa.table({"key": t["key"], "leaf": t["leaf"]} | {name: pa.array(values, pa.string()) for name, values in zip(names, zip(*out, strict=True), strict=True)})

    return leaves.groupBy("part").applyInArrow(proofs, kind)
