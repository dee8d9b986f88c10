"""Jaccard join of word n-gram sets, size-aware: subsets of small sets, inverted lists for large ones.

Shingles have one order for all sets: rare before frequent (by the load of hash buckets, of which there is a fixed
number), then by hash. Two similar sets share a shingle among the first few of each, and two among one more.

* Small sets enumerate all 2-subsets of that longer beginning: fewer, but much more telling keys.
* Large sets enter the inverted lists of the shingles of their beginning.
* The boundary is where the keys of the subsets outweigh the lists that they save; sets that may have a partner across
  it use both.

Equal sets are one class, so copies cost nothing. What links classes is found without writing out the pairs of a group:
in every list, classes that are known to be connected need no comparison, and comparisons of others go out as a forest.

1. Every member of a list is compared with the list's first class.
2. Lists with classes that are still apart are scanned; the pairs of short lists are joined. Sizes and parity bitmaps
   (the bits of two sets differ in no more places than their members) drop nearly all pairs that are not similar; of the
   others a spanning forest leaves a long list.
3. Forest edges are checked on the sets themselves, exactly. Lists with an edge that failed are scanned again, without it
   and with eight times as many pairs for an edge, so that the rounds are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, flat, in_rows, lists, save
from lodestone.llm.words import NOT_SPACE, bounds, chained, first_of_text, hashes, mix
from lodestone.operators.components import components
from lodestone.sources.shared import drop

#: Bits of the buckets whose loads tell rare from frequent shingles, and chunks in which their counts are summed.
BUCKET_BITS, CHUNKS = 18, 64
#: Largest set that may be small, members of a list whose pairs are joined, of one that a task scans, of a comparison group.
MOST_SMALL, SHORT, LIST, GROUP = 256, 16, 4096, 1000
#: Members of a list that are compared with all others at once.
AT_ONCE = 32
#: Bytes of texts, and heads of sets, that a task works on at once: what it holds meanwhile is some sixty times the texts.
TEXT_BYTES, HEADS = 500_000, 128
#: Bits of the fixed-size filter of the classes whose sets a pass needs.
FILTER_BITS = 1 << 24
_LEVEL = 58


class Rule:
    """The similarity: intersection * den >= num * union, of sets of ``words``-word shingles."""

    def __init__(self, words: int, num: int, den: int) -> None:
        self.words, self.num, self.den = words, num, den

    def beginning(self, n: np.ndarray, shared: int = 1) -> np.ndarray:
        """How many first shingles hold ``shared`` common ones with every similar set."""
        return np.minimum(n, n + -(-self.num * n // self.den) * -1 + shared)

    def overlap(self, a, b):
        """The least intersection of similar sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of each text as they occur, and the texts' offsets in them.

    A text with fewer words, but not none, has the sequence of all its words as its one shingle.
    """
    data, offsets = flat(texts)
    starts, ends, text = bounds(data, offsets, NOT_SPACE)
    h, n = hashes(data, starts, ends), len(texts)
    first = first_of_text(text, n)
    g = chained(h, words)
    whole = text[: len(g)] == text[words - 1 :] if len(g) else np.zeros(0, bool)
    of, g = text[: len(g)][whole], g[whole]
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < words))
    if len(short):
        more = np.concatenate([chained(h[first[k] : first[k + 1]], int(size[k])) + np.uint64(size[k]) for k in short.tolist()])
        order = np.argsort(np.append(of, short), kind="stable")
        of, g = np.append(of, short)[order], np.append(g, more)[order]
    return g, np.searchsorted(of, np.arange(n + 1))


def _levels(docs: DataFrame, rule: Rule) -> np.ndarray:
    """The level of each bucket of shingle hashes: 0 up to the mean load, then two a doubling."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in in_rows(batches, "text", TEXT_BYTES):
            g, _ = shingles(column(batch, "text"), rule.words)
            total += np.bincount((g >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(total, CHUNKS)], pa.binary())], names=["chunk", "load"])

    def add(chunk: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": chunk["chunk"][:1], "load": [np.sum([np.frombuffer(x, np.int64) for x in chunk["load"]], axis=0).tobytes()]})

    rows = docs.select("text").mapInArrow(load, "chunk int, load binary").groupBy("chunk").applyInPandas(add, "chunk int, load binary").collect()
    total = np.concatenate([np.frombuffer(r["load"], np.int64) for r in sorted(rows)]) if rows else np.zeros(1 << BUCKET_BITS, np.int64)
    mean = max(1.0, total.mean())
    return np.clip(2 * np.log2(np.maximum(total, 1) / mean), 0, 63).astype(np.uint8)


def _ordered(texts: pa.Array, rule: Rule, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle ids in the order of all sets, sorted within each text, and the texts' offsets."""
    g, first = shingles(texts, rule.words)
    v = (levels[(g >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(_LEVEL)) | (mix(g) >> np.uint64(64 - _LEVEL))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        v[a:b].sort()
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    new[first[:-1][first[:-1] < len(v)]] = True
    return v[new], np.concatenate([[0], np.cumsum(new)])[first]


def _classes_of(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(v + np.uint64(0x1234567)))])
    out = mix(sums[first[1:]] - sums[first[:-1]]) | np.uint64(1)
    out[np.diff(first) == 0] = 0
    return out.view(np.int64)


def bitmap_size(n: int) -> int:
    """Bits of a set's parity bitmap: a power of two, at least 256 and its size."""
    return max(256, 1 << (n - 1).bit_length())


def _bitmap(v: np.ndarray) -> bytes:
    bits = bitmap_size(len(v))
    return np.packbits(np.bincount((mix(v) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _sets(docs: DataFrame, rule: Rule, levels) -> DataFrame:
    """(doc_id, h, cls, n, head, bits) of each row; head: the first shingles, one more than a list key needs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches, "text", TEXT_BYTES):
            v, first = _ordered(column(batch, "text"), rule, levels.value)
            n = np.diff(first)
            cls = _classes_of(v, first)
            take = rule.beginning(n, 2)
            at = np.repeat(first[:-1], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            bits = [_bitmap(v[a:b]) if b > a else b"" for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "h"), pa.array(cls), pa.array(n), lists(v[at].view(np.int64), take, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "h", "cls", "n", "head", "bits"])

    return docs.mapInArrow(make, "doc_id long, h long, cls long, n long, head array<long>, bits binary")


def boundary(sizes: dict[int, int], scanned: float, rule: Rule) -> int:
    """The size up to which sets are small: the cheapest, counting keys of subsets, and keys of lists times what a list costs."""
    small = np.arange(MOST_SMALL + 1)
    count = np.array([sizes.get(n, 0) for n in small.tolist()], float)
    one, two = rule.beginning(small, 1), rule.beginning(small, 2)
    subsets, listed = count * two * (two - 1) / 2, count * one * (1 + scanned)
    cost = [subsets[: x + 1].sum() + listed[int(np.ceil(rule.num * x / rule.den)) :].sum() for x in small.tolist()]
    return int(np.argmin(cost))


def _keys(classes: DataFrame, rule: Rule, most_small: int) -> DataFrame:
    """(key, cls): subset keys and list keys of each class."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, HEADS) for whole in batches for at in range(0, whole.num_rows, HEADS)):
            cls, n, head = column(batch, "cls").to_numpy(), column(batch, "n").to_numpy(), column(batch, "head")
            first, flat_head = head.offsets.to_numpy(), head.flatten().to_numpy().view(np.uint64)
            first = first - first[0]
            of, out = [], []
            for k in np.flatnonzero(n <= most_small).tolist():
                x = flat_head[first[k] : first[k + 1]]
                i, j = np.triu_indices(len(x), 1)
                of.append(np.full(len(i), k))
                out.append(mix(mix(x[i]) + x[j]) | np.uint64(1 << 63))
            listed = np.flatnonzero(n * rule.den >= rule.num * most_small)
            take = rule.beginning(n[listed], 1)
            of.append(np.repeat(listed, take))
            out.append(flat_head[np.repeat(first[listed], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)] & np.uint64((1 << 63) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(cls[np.concatenate(of)])], names=["key", "cls"])

    return classes.select("cls", "n", "head").mapInArrow(keys, "key long, cls long")


def _near(x: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap (bytes) folded to ``size`` bytes."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


class _Bitmaps:
    """The parity bitmaps of a list's members, folded to every size that occurs."""

    def __init__(self, rule: Rule, n: np.ndarray, bits: list[np.ndarray]) -> None:
        self.rule, self.n, self.size = rule, n, np.array([len(x) for x in bits])
        self.folded = {}
        for size in np.unique(self.size).tolist():
            of = np.flatnonzero(self.size >= size)
            place = np.full(len(bits), -1)
            place[of] = np.arange(len(of))
            self.folded[size] = place, np.stack([_near(bits[k], size) for k in of.tolist()]).view(np.uint64)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs may be similar."""
        out, least = np.zeros(len(i), bool), np.minimum(self.size[i], self.size[j])
        most = self.n[i] + self.n[j] - 2 * self.rule.overlap(self.n[i], self.n[j])
        for size in np.unique(least).tolist():
            place, grid = self.folded[size]
            of = np.flatnonzero(least == size)
            for at in range(0, len(of), 1 + 4_000_000 // size):
                k = of[at : at + 1 + 4_000_000 // size]
                out[k] = np.bitwise_count(grid[place[i[k]]] ^ grid[place[j[k]]]).sum(1) <= most[k]
        return out


def _scan(members: dict[str, np.ndarray], rule: Rule, each: int) -> list[tuple[int, int]]:
    """Pairs of one list that may be similar, are apart, and have not failed yet: a spanning forest of their components,
    with up to ``each`` pairs for an edge."""
    order = np.argsort(members["n"], kind="stable")
    cls, label, n, side, bits, failed = (members[c][order] for c in ("cls", "label", "n", "side", "bits", "failed"))
    label, maps = label.copy(), _Bitmaps(rule, n, [np.frombuffer(x, np.uint8) for x in bits])
    high = np.searchsorted(n * rule.num, n * rule.den, side="right")  # the sets from here on are too large
    edges, found = [], {}
    for at in range(0, len(cls), AT_ONCE):
        own = np.arange(at, min(len(cls), at + AT_ONCE))
        count = high[own] - own - 1
        i = np.repeat(own, count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        # of a list in blocks, a task compares two blocks: sides 0 and 1, or 2 with all
        apart = (label[i] != label[j]) & ((side[i] == 2) | (side[i] != side[j]))
        i, j = i[apart], j[apart]
        near = maps.near(i, j)
        for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
            if label[x] != label[y] and cls[y] not in (failed[x] or ()) and cls[x] not in (failed[y] or ()):
                edges.append((int(cls[x]), int(cls[y])))
                ends = (min(label[x], label[y]), max(label[x], label[y]))
                found[ends] = found.get(ends, 0) + 1
                if found[ends] >= each:
                    label[label == label[y]] = label[x]
    return edges


def _forest(entries: DataFrame, classes: DataFrame, labels: DataFrame | None, failed: DataFrame | None, rule: Rule, each: int) -> DataFrame:
    """(key, a, b), saved: what the scans of all lists with classes that are apart leave to be checked."""
    rows = entries
    if labels is not None:
        rows = rows.join(labels, F.col("cls") == F.col("v"), "left").select("key", "cls", F.coalesce("label", "cls").alias("label"))
    else:
        rows = rows.withColumn("label", F.col("cls"))
    apart = rows.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).filter("low <> high").select("k", "m")
    rows = rows.join(apart, F.col("key") == F.col("k")).drop("k").join(classes.select(F.col("cls").alias("c"), "n"), F.col("cls") == F.col("c")).drop("c")
    rows = save(rows, "apart")
    short = rows.filter(F.col("m") <= SHORT).drop("m")
    a, b = (short.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("cls", "label", "n"))) for s in "ab")
    similar = (F.least("a_n", "b_n") * rule.den >= F.greatest("a_n", "b_n") * rule.num) & (F.col("a_cls") < F.col("b_cls")) & (F.col("a_label") != F.col("b_label"))
    pairs = a.join(b, "key").filter(similar).select("key", F.col("a_cls").alias("a"), F.col("b_cls").alias("b"))
    if failed is not None:
        pairs = pairs.join(failed, ["a", "b"], "left_anti")
    pairs = save(pairs, "pairs")  # at most SHORT / 2 a member
    kept = _filtered(pairs.select("a", "b").distinct(), classes, rule)
    out = save(pairs.join(kept, ["a", "b"], "left_semi").select("key", "a", "b").unionByName(_scanned(rows.filter(F.col("m") > SHORT), classes, failed, rule, each)), "forest")
    drop(rows, pairs)
    return out


def _scanned(rows: DataFrame, classes: DataFrame, failed: DataFrame | None, rule: Rule, each: int) -> DataFrame:
    """(key, a, b) from the lists of ``rows`` (key, cls, label, n, m), each read as a whole, or in blocks."""
    rows = rows.drop("n")
    own = classes.select(F.col("cls").alias("c"), "n", "bits")
    if failed is not None:
        not_again = failed.select(F.col("a").alias("f"), "b").union(failed.select(F.col("b").alias("f"), F.col("a").alias("b"))).groupBy("f").agg(F.collect_set("b").alias("failed"))
        own = own.join(not_again, F.col("c") == F.col("f"), "left").drop("f")
    else:
        own = own.withColumn("failed", F.lit(None).cast("array<long>"))
    # A longer list is cut into blocks, and every two blocks meet in a task of their own.
    n_blocks = F.ceil(F.col("m") / LIST).cast("int")
    block = F.pmod(F.xxhash64("cls"), n_blocks).cast("int")
    meetings = F.when(n_blocks == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda other: F.struct(F.least(block, other).cast("int").alias("i"), F.greatest(block, other).cast("int").alias("j"), F.when(block == other, 2).when(block < other, 0).otherwise(1).cast("int").alias("side")))
    )
    rows = rows.withColumn("at", F.explode(meetings)).select("key", "cls", "label", "at.*")
    rows = rows.join(own, F.col("cls") == F.col("c")).drop("c").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            whole = {c: rows.column(c).to_numpy() for c in rows.column_names if c not in ("bits", "failed")}
            whole |= {c: np.array([*rows.column(c).to_pylist(), None], object)[:-1] for c in ("bits", "failed")}
            new = np.flatnonzero(np.append(True, (whole["key"][1:] != whole["key"][:-1]) | (whole["i"][1:] != whole["i"][:-1]) | (whole["j"][1:] != whole["j"][:-1])))
            found = [(whole["key"][x], *edge) for x, y in zip(new.tolist(), [*new[1:].tolist(), rows.num_rows], strict=True) for edge in _scan({c: v[x:y] for c, v in whole.items()}, rule, each)]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([min(f[1:]) for f in found], pa.int64()), pa.array([max(f[1:]) for f in found], pa.int64())], names=["key", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            wait.append(batch)
            table = pa.Table.from_batches(wait)
            if table.num_rows < 2048:
                continue
            last = [table.column(c)[-1] for c in ("key", "i", "j")]
            same = np.ones(table.num_rows, bool)
            for c, x in zip(("key", "i", "j"), last, strict=True):
                same &= table.column(c).to_numpy() == x.as_py()
            cut = table.num_rows - int(same.sum())  # the last list may go on in the next batch
            if cut:
                yield done(table.slice(0, cut))
                wait = table.slice(cut).combine_chunks().to_batches()
        if wait:
            yield done(pa.Table.from_batches(wait))

    return rows.mapInArrow(scan, "key long, a long, b long")


def _filtered(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow."""
    a, b = (classes.select(F.col("cls").alias(f"{s}_c"), F.col("n").alias(f"{s}_n")) for s in "ab")
    rows = pairs.join(a, F.col("a") == F.col("a_c")).join(b, F.col("b") == F.col("b_c"))
    rows = rows.filter(F.least("a_n", "b_n") * rule.den >= F.greatest("a_n", "b_n") * rule.num)
    a, b = (classes.select(F.col("cls").alias(f"{s}_k"), F.col("bits").alias(f"{s}_bits")) for s in "ab")
    rows = rows.join(a, F.col("a") == F.col("a_k")).join(b, F.col("b") == F.col("b_k"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = column(batch, "a_n").to_numpy(), column(batch, "b_n").to_numpy()
            most = n + m - 2 * rule.overlap(n, m)
            keep = np.zeros(len(n), bool)
            for k, (x, y) in enumerate(zip(column(batch, "a_bits"), column(batch, "b_bits"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(p), len(q))
                keep[k] = np.bitwise_count((_near(p, size) ^ _near(q, size)).view(np.uint64)).sum() <= most[k]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(test, "a long, b long")


def _checked(pairs: DataFrame, docs: DataFrame, rule: Rule, levels) -> DataFrame:
    """(a, b, linked): the pairs, compared on the sets themselves. The saved table of pairs goes afterwards.

    Sets come from the texts again; a filter of fixed size keeps those that no pair needs from being moved. The set of a
    pair's first class moves once for up to GROUP second classes.
    """
    spark = docs.sparkSession
    shift = 64 - (FILTER_BITS.bit_length() - 1)
    needed = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    place = F.shiftrightunsigned("c", shift)
    words = needed.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(c, {shift}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches, "text", TEXT_BYTES):
            v, first = _ordered(column(batch, "text"), rule, levels.value)
            cls = _classes_of(v, first)
            at = cls.view(np.uint64) >> np.uint64(shift)
            keep = np.flatnonzero((held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0)
            keep = keep[np.sort(np.unique(cls[keep], return_index=True)[1])]
            if len(keep):
                raw = v.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(cls[keep]), pa.array([raw[8 * a : 8 * b] for a, b in zip(first[keep].tolist(), first[keep + 1].tolist(), strict=True)], pa.binary())], names=["s_cls", "ids"])

    every = docs.select("text").mapInArrow(sets, "s_cls long, ids binary").groupBy("s_cls").agg(F.first("ids").alias("ids"))
    groups = pairs.groupBy(F.col("a").alias("g")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    seconds = pairs.join(groups, F.col("a") == F.col("g")).select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"), F.col("b").alias("c"))
    firsts = groups.select(F.col("g").alias("a"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("g").alias("c"))
    rows = seconds.union(firsts).join(every, F.col("c") == F.col("s_cls")).select("a", "part", "c", "ids")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("c") != F.col("a"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, of = np.zeros(0, np.uint64), None
        for batch in batches:
            a, c, ids = column(batch, "a").to_pylist(), column(batch, "c").to_pylist(), column(batch, "ids")
            out: list[tuple[int, int, bool]] = []
            for k in range(batch.num_rows):
                x = np.frombuffer(ids[k].as_buffer(), np.uint64)
                if a[k] == c[k]:
                    first, of = x, a[k]
                    continue
                if of != a[k]:
                    raise ValueError("a pair came without its first set")
                both = len(np.intersect1d(first, x, assume_unique=True))
                out.append((a[k], c[k], both * rule.den >= rule.num * (len(first) + len(x) - both)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.bool_())], names=["a", "b", "linked"])

    out = save(rows.mapInArrow(compare, "a long, b long, linked boolean"), "checked")
    drop(pairs)
    return out


def similar_groups(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id, label, h) for each row of ``docs``.

    Two documents link when intersection * den >= num * union of their sets of distinct ``words``-word shingles (A-Z in
    lower case). component_id: the smallest doc_id reachable by links, the row's own included. Null text and text without
    words have the empty set and link with nothing. Rows that repeat a text link with each other; a null doc_id counts
    only where a component has no other. Shingles and sets are known by hashes of 58 and 64 bits.
    label: a number of the component, null for the empty set; h: the text's hash.
    """
    spark, rule = docs.sparkSession, Rule(words, num, den)
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    levels = spark.sparkContext.broadcast(_levels(own, rule))
    sets = save(_sets(own, rule, levels), "sets")
    full = sets.filter("n > 0").groupBy("cls")
    classes = save(full.agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    heads = save(full.agg(F.first("n").alias("n"), F.first("head").alias("head")), "heads")
    rows = save(sets.select("doc_id", "h", "cls", "n"), "members")
    drop(sets)
    sizes = {r["n"]: r["m"] for r in classes.filter(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count("*").alias("m")).collect()}
    seen = heads.groupBy(F.col("head")[0]).count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
    every = _keys(heads, rule, boundary(sizes, float(seen or 1), rule))
    shared = every.groupBy(F.col("key").alias("k")).agg(F.min("cls").alias("hub"), F.max("cls").alias("high")).filter("hub <> high").select("k", "hub")
    entries = save(every.join(shared, F.col("key") == F.col("k")).select("key", "cls", "hub"), "entries")
    drop(heads)

    stars = entries.filter("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    checked = _checked(save(_filtered(stars, classes, rule), "pairs"), own, rule, levels)
    links, failed = checked.filter("linked").select("a", "b"), checked.filter("not linked").select("a", "b")
    labels, keys, each = components(links), entries, 1
    while True:
        forest = _forest(keys.select("key", "cls"), classes, labels, failed, rule, each)
        if not forest.head(1):
            break
        checked = _checked(save(forest.select("a", "b").distinct(), "pairs"), own, rule, levels)
        links = links.union(checked.filter("linked").select("a", "b"))
        labels = components(links)
        wrong = checked.filter("not linked").select("a", "b")
        if not wrong.head(1):
            break
        failed = failed.union(wrong)
        again = forest.join(wrong, ["a", "b"], "left_semi").select(F.col("key").alias("k")).distinct()
        left = save(keys.select("key", "cls").join(again, F.col("key") == F.col("k"), "left_semi"), "keys")
        drop(keys, forest)
        keys, each = left, 8 * each

    of = classes.select("cls", "low").join(labels, F.col("cls") == F.col("v"), "left").select(F.col("cls").alias("c"), F.coalesce("label", "cls").alias("label"), "low")
    lows = of.groupBy(F.col("label").alias("l")).agg(F.min("low").alias("component_id"))
    of = of.join(lows, F.col("label") == F.col("l")).select("c", "component_id", "label")
    rows = rows.select("doc_id", "h", "cls", "n").join(of, F.col("cls") == F.col("c"), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "label", "h")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, then of the smallest hash of the text.

    Rows without words all stay. Rows alike in doc_id and text count as one row if they have words.
    """
    groups = similar_groups(docs, words, num, den).filter(F.col("label").isNotNull())
    best = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("k_best"))
    best = best.select(F.col("k_best.doc_id").alias("k_id"), F.col("k_best.h").alias("k_h")).distinct()
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("k_row"), F.col("doc_id").alias("k_doc"), F.xxhash64(text).alias("k_hash"), text.rlike(r"[^\x20\x09-\x0D]").alias("k_words"))
    kept = own.filter("k_words").join(best, F.col("k_doc").eqNullSafe(F.col("k_id")) & (F.col("k_hash") == F.col("k_h"))).dropDuplicates(["k_doc", "k_hash"])
    return kept.select("k_row.*").unionByName(own.filter("not k_words").select("k_row.*"))
