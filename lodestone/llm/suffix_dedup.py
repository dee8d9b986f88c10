"""Removal of long repeated byte strings by a depth-limited radix sort of suffixes.

A window is a string of LENGTH bytes. Windows are sorted digit by digit, most significant first, and only as deep as the
window; a group that is alone after a pass leaves the sort, and groups that are left after the last pass are exactly the
repeated windows. So that a pass need not move a row for every byte, digits are read from a place that the content fixes:

1. In every window, the CORE-byte string with the smallest hash among the first SPAN places is its core. Equal windows
   have their cores at equal places, so only core places (about two in SPAN) are rows, each for all windows around it.
   The first digit is the core; cores that occur once in the whole corpus leave.
2. Cores that are left move once to the task of their core, with the bytes around them if those differ. There the bytes
   behind the core are sorted by passes over eight bytes at a time, and those before it, read backwards, as well; rows
   that are alone after a pass leave. So the groups at every depth are known, and the windows with d bytes before the
   core are equal where the groups at depth d before it and at depth LENGTH - CORE - d behind it are. For each place it
   remembers the largest and the smallest d whose window occurs again: everything between the two windows is covered,
   since all windows around a place hold its core.

Rows of one core whose surroundings are equal count as one before they move. Cores with more than HOT different
surroundings (they may be fewer; copies in different batches count again) are grouped by Spark instead, a row for each d,
by a hash of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, flat, in_rows, lists, save
from lodestone.llm.words import mix, powers

LENGTH = 400
CORE = 200
SPAN = LENGTH - CORE + 1
SIDE = LENGTH - CORE
#: Bits of the filter of repeated cores that goes to the tasks; a fuller filter lets more through, never less.
FILTER_BITS = 1 << 27
#: The same for cores that one task should not sort; what it lets through besides is sorted the other way, to the same end.
HOT_BITS = 1 << 20
#: The same for cores with several surroundings; only these move with the bytes around them.
SEVERAL_BITS = 1 << 25
#: Different surroundings of one core that one task sorts at most, and rows that it sorts at once.
HOT, ROWS = 50_000, 4096
_LEFT, _RIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width] for every i where that is whole; van Herk's two passes."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    grid = np.empty(blocks * width, x.dtype)
    grid[: len(x)], grid[len(x) :] = x, x[-1]
    grid = grid.reshape(blocks, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=total[1:])
    return total


def cores(total: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cores of all windows, and the cores' hashes; total: as _sums() gives it."""
    size = len(total) - 1
    n = size - CORE + 1
    if size < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    down = powers(size)[1]
    h = mix((total[CORE:] - total[:n]) * down[:n]) | np.uint64(1)
    least = _sliding(h, SPAN, np.minimum)
    # a window must lie in one text; 0 is below every hash, so it picks nothing
    starts = np.arange(len(least))
    cut = offsets[1:-1]
    inside = np.zeros(size + 1, np.int32)
    np.add.at(inside, np.maximum(cut - LENGTH + 1, 0), 1)
    np.add.at(inside, cut, -1)
    least[np.cumsum(inside)[starts] > 0] = 0
    reach = _sliding(np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)]), SPAN, np.maximum)
    at = np.flatnonzero(reach == h)
    return at, h[at]


def _sides(offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each core place: its text, and start and end of the bytes around its core, up to SIDE on each side."""
    text = np.searchsorted(offsets, at, side="right") - 1
    low, high = np.maximum(at - SIDE, offsets[text]), np.minimum(at + CORE + SIDE, offsets[text + 1])
    return text, low, at, at + CORE, high


def _around(total: np.ndarray, low: np.ndarray, at: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the core and the bytes around it, and where the core stands among them."""
    down = powers(len(total) - 1)[1]
    return mix(mix((total[high] - total[low]) * down[low]) + (at - low).astype(np.uint64) * _LEFT + (high - low).astype(np.uint64) * _RIGHT)


def _count_cores(docs: DataFrame) -> DataFrame:
    """(core, n, m, low, high) of the cores that occur again; m: at least the number of their different surroundings, of
    which low and high are the smallest and the largest hash.

    m counts equal surroundings once a batch, so copies hardly add to it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches, "text"):
            data, offsets = flat(column(batch, "text"))
            total = _sums(data)
            at, h = cores(total, offsets)
            _, low, _, _, high = _sides(offsets, at)
            keys, n = np.unique(h, return_counts=True)
            around, first = np.unique(_around(total, low, at, high).view(np.int64), return_index=True)
            of = np.searchsorted(keys, h[first])
            order = np.argsort(of, kind="stable")  # by core, then by surrounding
            around, of = around[order], of[order]
            ends = np.searchsorted(of, np.arange(len(keys) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(np.diff(ends).astype(np.int32)), pa.array(around[ends[:-1]]), pa.array(around[ends[1:] - 1])], names=["core", "n", "m", "low", "high"]
            )

    counts = docs.select("text").mapInArrow(count, "core long, n int, m int, low long, high long").groupBy("core")
    return counts.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.min("low").alias("low"), F.max("high").alias("high")).filter("n > 1")


def _filter(cores_: DataFrame, n_bits: int) -> np.ndarray:
    """A bitmap of n_bits (a power of two) of the cores: of fixed size, however many they are.

    A core's place is its low bits without the last, which is always set: cores are minima, so their top bits are mostly 0.
    """
    place = F.shiftrightunsigned("core", 1).bitwiseAND(F.lit(n_bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = cores_.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = (h >> np.uint64(1)) & np.uint64(64 * len(bits) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


_CONTEXT = "core long, around long, n int, before int, behind int, left binary, right binary"


def _contexts(docs: DataFrame, bits, hot: bool) -> DataFrame:
    """Cores that may repeat: one row for those of a batch with equal surroundings, with how many bytes stand around them.

    bits: the filters; hot: of the cores that pass the second one, or of the others. The bytes themselves are in all rows
    of the former and in rows of cores that pass the third filter: elsewhere a core with one surrounding needs none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches, "text"):
            data, offsets = flat(column(batch, "text"))
            total = _sums(data)
            at, h = cores(total, offsets)
            keep = _passes(bits.value[0], h) & (_passes(bits.value[1], h) == hot)
            at, h = at[keep], h[keep]
            if not len(at):
                continue
            _, low, at, end, high = _sides(offsets, at)
            around, first, n = np.unique(_around(total, low, at, high), return_index=True, return_counts=True)
            raw = data.tobytes()
            low, at, end, high = low[first], at[first], end[first], high[first]
            several = _passes(bits.value[2], h[first]) | hot
            left = [raw[a:b] if x else b"" for a, b, x in zip(low.tolist(), at.tolist(), several.tolist(), strict=True)]
            right = [raw[a:b] if x else b"" for a, b, x in zip(end.tolist(), high.tolist(), several.tolist(), strict=True)]
            sizes = [pa.array((at - low).astype(np.int32)), pa.array((high - end).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first].view(np.int64)), pa.array(around.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32)), *sizes, pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=["core", "around", "n", "before", "behind", "left", "right"],
            )

    return docs.select("text").mapInArrow(cut, _CONTEXT)


def _prefixes(column_: pa.Array, from_end: bool, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first 0 to SIDE bytes of each row (of the last ones, read backwards, if from_end), and the rows' sizes."""
    data, offsets = flat(column_)
    size = np.diff(offsets)
    out = np.zeros((len(size), SIDE + 1), np.uint64)
    weight, data = np.uint64(1), np.append(data, 0)
    for k in range(SIDE):
        weight = np.multiply(weight, base, dtype=np.uint64)
        place = (offsets[1:] - 1 - k) if from_end else (offsets[:-1] + k)
        byte = data[np.clip(place, 0, len(data) - 1)].astype(np.uint64) + np.uint64(1)
        out[:, k + 1] = out[:, k] + np.where(k < size, byte * weight, np.uint64(0))
    return out, size


class _Around:
    """The windows around the cores of some rows, by the number d of bytes before the core."""

    def __init__(self, core: np.ndarray, left: pa.Array, right: pa.Array) -> None:
        self.core = core
        self.before, self.n_before = _prefixes(left, True, _LEFT)
        self.behind, self.n_behind = _prefixes(right, False, _RIGHT)

    def keys(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have a window with d bytes before the core, and the hashes of these windows."""
        rows = np.flatnonzero((d <= self.n_before) & (SIDE - d <= self.n_behind))
        return rows, mix(mix(self.before[rows, d] + self.core[rows]) + self.behind[rows, SIDE - d] + np.uint64(d) * np.uint64(0xD6E8FEB86659FD93 >> 8))


#: Bytes that one pass sorts by.
DIGIT = 8


def _ranked(core: np.ndarray, side: pa.Array, from_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of core and ``side`` (read backwards if from_end), how many bytes each has in common with the row
    before it (-1 where the core is another), and the sides' sizes.

    A most-significant-digit radix sort, SIDE bytes deep: each pass sorts what is still in groups by one more digit.
    """
    data, offsets = flat(side)
    data, size, n = np.append(data, 0), np.diff(offsets), len(core)
    order = np.argsort(core, kind="stable")
    tied = np.append(False, core[order[1:]] == core[order[:-1]])  # in one group with the row before
    common = np.where(tied, SIDE, -1)
    for first in range(0, SIDE, DIGIT):
        held = np.flatnonzero(tied | np.append(tied[1:], False))  # others are alone and leave
        if not len(held):
            break
        rows, group = order[held], np.cumsum(~tied[held])
        place = first + np.arange(DIGIT)
        at = (offsets[1:][rows][:, None] - 1 - place) if from_end else (offsets[:-1][rows][:, None] + place)
        digit = np.where(place < size[rows][:, None], data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8).view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((digit, group))
        order[held], digit = rows[by], digit[by]
        split = np.flatnonzero((digit[1:] != digit[:-1]) & (group[1:] == group[:-1])) + 1
        apart = digit[split] ^ digit[split - 1]
        alike = sum((apart >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, DIGIT))
        common[held[split]], tied[held[split]] = first + alike, False
    both = np.minimum(size[order[1:]], size[order[:-1]])
    common[1:] = np.where(common[1:] < 0, -1, np.minimum(common[1:], both))
    return order, common, size


def _sorted(core: np.ndarray, around: np.ndarray, n: np.ndarray, left: pa.Array, right: pa.Array) -> tuple[np.ndarray, ...]:
    """(core, around, most, least) of the rows of which some window occurs again; rows hold all of their cores."""
    (order_l, common_l, before), (order_r, common_r, behind) = _ranked(core, left, True), _ranked(core, right, False)
    most, least = np.full(len(core), -1), np.full(len(core), SPAN)
    group_l, group_r = np.empty(len(core), np.int64), np.empty(len(core), np.int64)
    for d in range(SPAN):
        rows = np.flatnonzero((d <= before) & (SIDE - d <= behind))
        if not len(rows):
            continue
        group_l[order_l], group_r[order_r] = np.cumsum(common_l < d), np.cumsum(common_r < SIDE - d)
        keys = group_l[rows] * (len(core) + 1) + group_r[rows]
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        again = n[rows] > 1  # equal surroundings: all their windows
        again[order[same]] = again[order[same + 1]] = True
        most[rows[again]] = d
        least[rows[again]] = np.minimum(least[rows[again]], d)
    hit = most >= 0
    return core[hit], around[hit], most[hit], least[hit]


_WINDOWS = "core long, around long, most int, least int"


def _windows(contexts: DataFrame) -> DataFrame:
    """(core, around, most, least): the second and third digit for all rows of a core together."""
    spark = contexts.sparkSession
    held = contexts.repartition("core").sortWithinPartitions("core", "around")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []

        def done(rows: pa.RecordBatch) -> pa.RecordBatch:
            core, around = (column(rows, c).to_numpy().view(np.uint64) for c in ("core", "around"))
            first = np.flatnonzero(np.append(True, (core[1:] != core[:-1]) | (around[1:] != around[:-1])))
            n = np.add.reduceat(column(rows, "n").to_numpy(), first)
            core, around = core[first], around[first]
            own = np.diff(np.append(np.flatnonzero(np.append(True, core[1:] != core[:-1])), len(core)))
            single = np.repeat(own, own) == 1
            take = pa.array(first[~single])
            out = _sorted(core[~single], around[~single], n[~single], column(rows, "left").take(take), column(rows, "right").take(take))
            # a core with one surrounding: all windows that it has room for, if it occurs again
            before, behind = (np.minimum(column(rows, c).to_numpy()[first], SIDE) for c in ("before", "behind"))
            again = single & (n > 1) & (before + behind >= SIDE)
            out = [np.concatenate([x, y[again]]) for x, y in zip(out, (core, around, before, SIDE - behind), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64)), pa.array(out[2].astype(np.int32)), pa.array(out[3].astype(np.int32))], names=["core", "around", "most", "least"])

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(wait).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            wait.append(batch)
            if sum(b.num_rows for b in wait) < ROWS:
                continue
            rows = joined()
            last = column(rows, "core").to_numpy()
            cut = int(np.searchsorted(last, last[-1]))  # the last core may go on in the next batch
            if cut:
                yield done(rows.slice(0, cut))
            wait = [rows.slice(cut)]
        if wait:
            yield done(joined())

    return held.mapInArrow(sort, _WINDOWS)


def _hot_windows(contexts: DataFrame) -> DataFrame:
    """As _windows, for cores with very many surroundings: a row for each d, grouped by Spark with partial sums."""
    once = contexts.groupBy("core", "around").agg(F.sum("n").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            core, around, n = (column(batch, c).to_numpy() for c in ("core", "around", "n"))
            windows = _Around(core.view(np.uint64), column(batch, "left"), column(batch, "right"))
            for d in range(SPAN):
                row, keys = windows.keys(d)
                yield pa.RecordBatch.from_arrays([pa.array(core[row]), pa.array(around[row]), pa.array(n[row]), pa.array(np.full(len(row), d, np.int32)), pa.array(keys.view(np.int64))], names=["core", "around", "n", "d", "key"])

    rows = once.mapInArrow(spread, "core long, around long, n long, d int, key long")
    again = rows.groupBy("d", "key").agg(F.sum("n").alias("m")).filter("m > 1").withColumnsRenamed({"d": "a_d", "key": "a_key"})
    return rows.join(again, (F.col("d") == F.col("a_d")) & (F.col("key") == F.col("a_key"))).groupBy("core", "around").agg(F.max("d").alias("most"), F.min("d").alias("least"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, spans): the byte runs of each text that a repeated window covers, as a flat array of starts and ends.

    Texts without such runs have no row. h: the text's hash; rows alike in doc_id and text have one row here.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    long = own.filter(F.octet_length("text") >= LENGTH)
    repeated = save(_count_cores(long), "cores")
    hot, several = repeated.filter(F.col("m") > HOT), repeated.filter("low <> high")
    bits = spark.sparkContext.broadcast((_filter(repeated, FILTER_BITS), _filter(hot, HOT_BITS), _filter(several.unionByName(hot), SEVERAL_BITS)))
    found = _windows(_contexts(long, bits, False))
    if hot.head(1):
        found = found.unionByName(_hot_windows(_contexts(long, bits, True)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches, "text"):
            data, offsets = flat(column(batch, "text"))
            total = _sums(data)
            at, h = cores(total, offsets)
            keep = _passes(bits.value[0], h)
            at, h = at[keep], h[keep]
            text, low, at, _, high = _sides(offsets, at)
            around = _around(total, low, at, high)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(pa.array(text)), column(batch, "h").take(pa.array(text)), pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(at - offsets[text])], names=["doc_id", "h", "p_core", "p_around", "at"]
            )

    rows = long.mapInArrow(places, "doc_id long, h long, p_core long, p_around long, at long")
    span = F.struct((F.col("at") - F.col("most")).alias("a"), (F.col("at") + LENGTH - F.col("least")).alias("z"))
    return (
        rows.join(found, (F.col("p_core") == F.col("core")) & (F.col("p_around") == F.col("around")))
        .groupBy("doc_id", "h")
        .agg(F.array_sort(F.collect_set(span)).alias("spans"))
    )


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, spans) for each row of ``docs``: its bytes without those that a repeated window covers.

    kept: the remaining bytes; spans: flat starts and ends of the maximal removed runs. Null text is empty. A row that
    repeats another one's text loses all of it that lies in windows; texts shorter than LENGTH bytes keep everything.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    spans = repeated_spans(docs).select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), F.transform("spans", lambda s: s["a"]).alias("low"), F.transform("spans", lambda s: s["z"]).alias("high"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches, "text"):
            data, offsets = flat(column(batch, "text"))
            mark = np.zeros(len(data) + 1, np.int32)
            low, high = (column(batch, c) for c in ("low", "high"))
            base = np.repeat(offsets[:-1], np.nan_to_num(low.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            np.add.at(mark, base + low.flatten().to_numpy(), 1)
            np.add.at(mark, base + high.flatten().to_numpy(), -1)
            gone = np.cumsum(mark)[:-1] > 0
            edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
            cuts = offsets[1:-1]
            cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
            cuts = cuts[gone[cuts] & gone[cuts - 1]]
            starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), cuts]))
            ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), cuts]))
            of = np.searchsorted(offsets, starts, side="right") - 1
            runs = np.stack([starts - offsets[of], ends - offsets[of]], 1).ravel()
            left = data[~gone].tobytes()
            size = np.concatenate([[0], np.cumsum(~gone)])[offsets].tolist()
            kept = [left[a:b] for a, b in zip(size[:-1], size[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), lists(runs, 2 * np.bincount(of, minlength=batch.num_rows), pa.int64())], names=["doc_id", "kept", "n_bytes", "spans"]
            )

    rows = own.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left")
    none = F.array().cast("array<bigint>")
    return rows.select("doc_id", "text", F.coalesce("low", none).alias("low"), F.coalesce("high", none).alias("high")).mapInArrow(cut, "doc_id long, kept binary, n_bytes long, spans array<long>")
