"""Line dedup: sharded cuckoo filters over exact reference counts.

The exact table counts the lines of each key in each document. From it come the keys that at least two documents
hold, and one cuckoo filter of those keys a shard. A line whose key its shard's filter does not know is kept without
a look at the exact table; the others are joined with it. Insertions and deletions change the counts, and with them
the filters, so both can be undone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, save

#: Characters taken off both ends of a line before it is compared.
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints, two possible buckets for a key.

    Keys are 64-bit hashes. ``insert`` places many keys at once: what does not fit into its first bucket tries the
    second, then fingerprints are moved as in the sequential filter; fingerprints that find no place after ``MOVES``
    rounds are kept apart, exactly, in ``extra``. ``contains`` has no false negatives. ``delete`` takes out one fingerprint a key, so it is only
    for keys that were inserted.
    """

    SLOTS, MOVES = 4, 64

    def __init__(self, n_keys: int, slots: np.ndarray | None = None) -> None:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n_keys) / (self.SLOTS * 0.8)))))
        self.slots = np.zeros((buckets, self.SLOTS), np.uint16) if slots is None else slots
        self.extra: set[int] = set()  # keys that no move could place, kept exactly

    @classmethod
    def loads(cls, raw: bytes) -> Cuckoo:
        n = int.from_bytes(raw[:8], "little")
        out = cls(1, np.frombuffer(raw[8 + 8 * n :], np.uint16).reshape(-1, cls.SLOTS).copy())
        out.extra = set(np.frombuffer(raw[8 : 8 + 8 * n], np.uint64).tolist())
        return out

    def dumps(self) -> bytes:
        return len(self.extra).to_bytes(8, "little") + np.array(sorted(self.extra), np.uint64).tobytes() + self.slots.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (keys >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & (len(self.slots) - 1))

    def insert(self, keys: np.ndarray) -> None:
        keys = np.asarray(keys, np.uint64)
        mark, bucket, _ = self._places(keys)
        left = np.arange(len(keys))
        rng = np.random.default_rng(0)
        for move in range(self.MOVES):
            if not len(left):
                return
            order = np.argsort(bucket[left], kind="stable")
            left = left[order]
            at = bucket[left]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            free = self.slots[at] == 0
            fits = rank < free.sum(1)
            slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, self.SLOTS - 1)]
            self.slots[at[fits], slot[fits]] = mark[left[fits]]
            left = left[~fits]
            if move % 2 == 0:
                bucket[left] = self._other(bucket[left], mark[left])
            elif len(left):  # one key a bucket takes the place of a fingerprint, which goes to its other bucket
                _, one = np.unique(bucket[left], return_index=True)
                who, where = left[one], bucket[left[one]]
                spot = rng.integers(0, self.SLOTS, len(who))
                out = self.slots[where, spot].copy()
                self.slots[where, spot] = mark[who]
                mark[who], bucket[who] = out, self._other(where, out)
        if len(left):
            # Fingerprints that were moved out belong to unknown keys, so the only exact thing to keep is their place.
            self.extra.update(((mark[left].astype(np.uint64) << np.uint64(48)) | bucket[left].astype(np.uint64)).tolist())

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        mark, first, second = self._places(keys)
        found = (self.slots[first] == mark[:, None]).any(1) | (self.slots[second] == mark[:, None]).any(1)
        if self.extra:
            own = np.array(sorted(self.extra), np.uint64)
            high = mark.astype(np.uint64) << np.uint64(48)
            found |= np.isin(high | first.astype(np.uint64), own) | np.isin(high | second.astype(np.uint64), own)
        return found

    def delete(self, keys: np.ndarray) -> None:
        mark, first, second = self._places(np.asarray(keys, np.uint64))
        for m, *places in zip(mark.tolist(), first.tolist(), second.tolist(), strict=True):
            for b in places:
                spot = np.flatnonzero(self.slots[b] == m)
                if len(spot):
                    self.slots[b, spot[0]] = 0
                    break
                if (k := (m << 48) | b) in self.extra:
                    self.extra.discard(k)
                    break


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased; ``lower`` does just that where all is ASCII."""
    key = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, h, at, k1, k2): the keys of at least ``least`` code points by two 64-bit hashes; h: the text's hash."""
    text = F.coalesce("text", F.lit(""))
    return (
        docs.select("doc_id", F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
        .select("doc_id", "h", "at", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= least)
        .select("doc_id", "h", "at", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"))
    )


def _counted(rows: DataFrame, name: str) -> DataFrame:
    """The exact table: lines of each key in each document, partly summed before the shuffle."""
    return save(rows.groupBy("k1", "k2", "doc_id").agg(F.sum("n").alias("n")).filter("n > 0"), name)


def _repeated(refs: DataFrame) -> DataFrame:
    """(k1, k2, low): keys that at least two documents hold, with the smallest; documents without an id are one, behind all others."""
    held = refs.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    return held.filter((F.col("low") != F.col("high")) | (F.col("low").isNotNull() & F.col("unnamed"))).select("k1", "k2", "low")


class LineIndex:
    """Which lines several documents share; takes documents in and out again.

    refs: the exact table (k1, k2, doc_id, n). twice: the keys in at least two documents. filters: one cuckoo filter
    a shard over ``twice``. All three are tables in the shared folder. Documents are put in once each and taken out
    with the text they came with; afterwards the index equals one built without them.
    """

    #: Keys in one shard's filter when it is built; the filters have room for twice as many.
    SHARD_KEYS = 500_000
    #: Filters of at most so many bytes are broadcast; beyond it lines and filters meet by shard.
    BROADCAST_BYTES = 64_000_000
    #: Tasks that the lines of one shard are dealt to then, each with a copy of the shard's filter.
    COPIES = 16

    def __init__(self, refs: DataFrame, least: int, twice: DataFrame | None = None, filters: DataFrame | None = None, n_built: int | None = None) -> None:
        self.refs, self.least = refs, least
        self.twice = twice if twice is not None else save(_repeated(refs), "twice")
        self.n_built = self.twice.count() if n_built is None else n_built
        self.n_shards = max(1, -(-self.n_built // self.SHARD_KEYS))
        self.filters = filters if filters is not None else self._updated(None, self.twice, None)

    @classmethod
    def build(cls, docs: DataFrame, least: int = 10) -> LineIndex:
        return cls.of_lines(lines(docs, least), least)

    @classmethod
    def of_lines(cls, rows: DataFrame, least: int) -> LineIndex:
        """The index of the documents that ``rows`` of lines() came from."""
        return cls(_counted(rows.withColumn("n", F.lit(1)), "refs"), least)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        new = lines(docs, self.least).withColumn("n", F.lit(sign).cast("long")).select("k1", "k2", "doc_id", "n")
        refs = _counted(self.refs.unionByName(new), "refs")
        twice = save(_repeated(refs), "twice")
        if twice.count() > 2 * self.n_built:
            return LineIndex(refs, self.least, twice)
        filters = self._updated(self.filters, twice.join(self.twice, ["k1", "k2"], "left_anti"), self.twice.join(twice, ["k1", "k2"], "left_anti"))
        return LineIndex(refs, self.least, twice, filters, self.n_built)

    def _updated(self, filters: DataFrame | None, come: DataFrame, go: DataFrame | None) -> DataFrame:
        n_shards, room = self.n_shards, 2 * -(-self.n_built // self.n_shards)
        shard = F.pmod("k2", F.lit(n_shards)).cast("int").alias("shard")
        keys = come.select(shard, "k1", F.lit(True).alias("come"))
        if go is not None:
            keys = keys.unionByName(go.select(shard, "k1", F.lit(False).alias("come")))
        if filters is None:
            filters = come.sparkSession.createDataFrame([], "shard int, cuckoo binary")

        def one(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
            cuckoo = Cuckoo.loads(old["cuckoo"].iloc[0]) if len(old) else Cuckoo(room)
            cuckoo.insert(change.loc[change["come"], "k1"].to_numpy(np.int64).view(np.uint64))
            cuckoo.delete(change.loc[~change["come"], "k1"].to_numpy(np.int64).view(np.uint64))
            return pd.DataFrame({"shard": [int((old if len(old) else change)["shard"].iloc[0])], "cuckoo": [cuckoo.dumps()]})

        return save(filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(one, "shard int, cuckoo binary"), "filters")

    def shared(self, rows: DataFrame) -> DataFrame:
        """``rows`` of lines() whose key may be in ``twice``: all that are, and few others."""
        size = self.filters.agg(F.sum(F.length("cuckoo"))).first()[0] or 0
        if size > self.BROADCAST_BYTES:
            return self._shared_by_shard(rows)
        n_shards = self.n_shards
        held = rows.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["cuckoo"]) for r in self.filters.collect()})

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: Cuckoo.loads(v) for k, v in held.value.items()}
            for batch in batches:
                k1, k2 = (column(batch, c).to_numpy() for c in ("k1", "k2"))
                keep, shard = np.zeros(len(k1), bool), np.mod(k2, n_shards)
                for k, cuckoo in filters.items():
                    of = np.flatnonzero(shard == k)
                    keep[of] = cuckoo.contains(k1[of].view(np.uint64))
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(test, rows.schema)

    def _shared_by_shard(self, rows: DataFrame) -> DataFrame:
        """As shared(), for filters of any total size: each shard's lines follow a copy of its filter through a task.

        A task holds one filter and one batch of lines at a time, and a hot key's lines go to COPIES tasks.
        """
        shard, copy = F.pmod("k2", F.lit(self.n_shards)).cast("int"), F.pmod(F.xxhash64("doc_id", "at"), F.lit(self.COPIES)).cast("int")
        own = [F.col(c) for c in rows.columns]
        sent = rows.select(shard.alias("of_shard"), copy.alias("copy"), F.lit(1).alias("turn"), F.lit(None).cast("binary").alias("cuckoo"), *own)
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
        every = F.explode(F.sequence(F.lit(0), F.lit(self.COPIES - 1))).alias("copy")
        sent = sent.unionByName(self.filters.select(F.col("shard").alias("of_shard"), every, F.lit(0).alias("turn"), "cuckoo", *none))
        sent = sent.repartition("of_shard", "copy").sortWithinPartitions("of_shard", "copy", "turn")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, cuckoo = -1, None
            for batch in batches:
                shard_, turn, k1 = (column(batch, c) for c in ("of_shard", "turn", "k1"))
                shard_, keep = shard_.to_numpy(), np.zeros(batch.num_rows, bool)
                k1 = k1.fill_null(0).to_numpy().view(np.uint64)
                cuts = np.flatnonzero(np.append(True, shard_[1:] != shard_[:-1])).tolist()
                for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                    filters = np.flatnonzero(turn.to_numpy()[a:b] == 0)
                    if len(filters):
                        now, cuckoo = shard_[a], Cuckoo.loads(column(batch, "cuckoo")[a + int(filters[0])].as_py())
                    if cuckoo is not None and now == shard_[a]:
                        keep[a:b] = cuckoo.contains(k1[a:b])
                    keep[a:b][filters] = False
                yield batch.filter(pa.array(keep)).select([f.name for f in rows_schema])

        rows_schema = rows.schema
        return sent.mapInArrow(test, rows_schema)

    def dedup(self, docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
        """``docs`` as (doc_id, text, n_lines, n_dropped) without the lines that a smaller doc_id of the index holds too.

        found: lines() of ``docs``, if they are there already.
        """
        text = F.coalesce("text", F.lit(""))
        own = docs.select("doc_id", F.xxhash64(text).alias("h"), F.split(text, "\n", -1).alias("lines"))
        rows = self.shared(lines(docs, self.least) if found is None else found)
        # One row for a key and many for its lines: Spark splits a hot key's side of this join.
        gone = (
            rows.join(self.twice.withColumnsRenamed({"k1": "j1", "k2": "j2"}), (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")))
            .filter(~F.col("doc_id").eqNullSafe(F.col("low")))
            .groupBy(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"))
            .agg(F.collect_set("at").alias("gone"))
        )
        left = F.expr("array_except(sequence(0, size(lines) - 1), gone)")
        return own.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left").select(
            "doc_id",
            F.concat_ws("\n", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.col("lines")[i]))).alias("text"),
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        )


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """Line dedup of one table: an index of all its documents, applied to them.

    Result: (doc_id, text, n_lines, n_dropped) for each row. Null or empty text is one empty line. Keys shorter than
    ``least`` code points never count. Rows that repeat a doc_id are one document and keep the same lines. Documents
    with a null doc_id are one document behind all others. An empty table gives an empty table.
    """
    found = save(lines(docs, least), "lines")
    return LineIndex.of_lines(found, least).dedup(docs, found)
