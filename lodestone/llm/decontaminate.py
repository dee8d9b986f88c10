"""Benchmark decontamination by winnowing.

Both sides are sequences of words, known by their hashes. From every GRAM consecutive words comes a hash; from every
SPAN consecutive such hashes the smallest is kept as a fingerprint (all places of it, if it occurs twice). GRAM + SPAN - 1
words make one window, so every shared window has a shared fingerprint. Where a document's fingerprint is one of the
benchmark's, the windows around it are compared whole. Items shorter than a window are one window of their own length and
are looked for at every place.

The benchmark goes out in blocks of a bounded number of words; each block is one pass over the documents, without a
shuffle. Results of several blocks meet per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, flat, in_rows, lists
from lodestone.llm.words import LETTER_OR_DIGIT, bounds, chained, first_of_text, hashes

#: Words in a fingerprint's gram, grams in one winnowing span, and so words in a window.
GRAM, SPAN = 5, 6
WINDOW = GRAM + SPAN - 1
#: Bytes of benchmark text in one block at most (an item longer than that is a block's only one).
BLOCK_BYTES = 8_000_000


def windows(h: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words, and whether all of them are in one text."""
    g = chained(h, k)
    return g, text[: len(g)] == text[k - 1 :] if len(g) else np.zeros(0, bool)


def fingerprints(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Numbers of the words at which a kept gram begins."""
    g, whole = windows(h, text, GRAM)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = g[:n].copy()
    for j in range(1, SPAN):
        np.minimum(least, g[j : n + j], out=least)
    inside = text[:n] == text[WINDOW - 1 :]
    kept = np.zeros(len(g), bool)
    for j in range(SPAN):
        kept[j : n + j] |= inside & (g[j : n + j] == least)
    return np.flatnonzero(kept)


class Index:
    """Fingerprints and windows of one block of the benchmark."""

    def __init__(self, item_ids: list[str | None], texts: pa.Array) -> None:
        data, offsets = flat(texts)
        starts, ends, text = bounds(data, offsets, LETTER_OR_DIGIT)
        h = hashes(data, starts, ends)
        self.item_ids = item_ids
        size = np.diff(first_of_text(text, len(offsets) - 1))
        g, _ = windows(h, text, GRAM)
        self.marks = np.unique(g[fingerprints(h, text)]) if len(g) else g
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in {WINDOW, *size[(size > 0) & (size < WINDOW)].tolist()}:
            w, whole = windows(h, text, k)
            at = np.flatnonzero(whole & ((size[text[: len(w)]] == k) | (k == WINDOW))) if len(w) else np.zeros(0, np.int64)
            pairs = np.unique(np.rec.fromarrays([w[at], text[at]], names="w,i"))
            keys, first = np.unique(pairs["w"], return_index=True)
            self.windows[k] = keys, np.append(first, len(pairs)), pairs["i"].astype(np.int64)

    def hits(self, h: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, list[list[str]]]:
        """Which words are hit, and the ids of the items that each text has windows of."""
        hit = np.zeros(len(h) + 1, np.int64)
        found: list[set[int]] = [set() for _ in range(n_texts)]
        for k, (keys, first, items) in self.windows.items():
            w, whole = windows(h, text, k)
            if not len(w) or not len(keys):
                continue
            if k == WINDOW:  # only around shared fingerprints
                marked = fingerprints(h, text)
                marked = marked[_place(self.marks, chained(h, GRAM)[marked]) >= 0]
                at = np.unique((marked[:, None] - np.arange(SPAN)).ravel())
                at = at[(at >= 0) & (at < len(w))]
                at = at[whole[at]]
            else:
                at = np.flatnonzero(whole)
            key = _place(keys, w[at])
            at, key = at[key >= 0], key[key >= 0]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + k, -1)
            for t, i in np.unique(np.stack([text[at], key], 1), axis=0).tolist():
                found[t].update(items[first[i] : first[i + 1]].tolist())
        return np.cumsum(hit)[:-1] > 0, [sorted({str(self.item_ids[i]) for i in x if self.item_ids[i] is not None}) for x in found]


def _place(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The number of each x among the sorted keys, -1 if it is none."""
    if not len(keys):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, h) for each row of ``docs``; items: sorted ids of the items found, as strings.

    Null text has no words and null items no windows. Items that repeat an id count once; an item without an id hits
    words but is not listed. Rows that repeat, or have a null doc_id, are rows of their own. h: the text's hash.
    Hashes of 64 bits stand for words and windows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    parts = []
    for b in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).toArrow()
        held = spark.sparkContext.broadcast((block.column("item").to_pylist(), block.column("text").combine_chunks()))

        def test(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(held.value[0], _one(held.value[1]))
            for batch in in_rows(batches, "text"):
                data, offsets = flat(column(batch, "text"))
                starts, ends, at = bounds(data, offsets, LETTER_OR_DIGIT)
                hit, found = index.hits(hashes(data, starts, ends), at, batch.num_rows)
                first = first_of_text(at, batch.num_rows)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                edge = np.unique(np.concatenate([edge, first[1:-1][hit[np.minimum(first[1:-1], len(hit) - 1)]] if len(hit) else first[:0]]))
                low, high = edge[:-1], edge[1:]  # runs cut at the texts' ends
                own_run = hit[np.minimum(low, len(hit) - 1)] if len(hit) else np.zeros(0, bool)
                low, high = low[own_run], high[own_run]
                of = at[low] if len(low) else low
                runs = np.stack([low - first[of], high - first[of]], 1).ravel() if len(low) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id"), column(batch, "h"), pa.array(np.diff(first)), lists(runs, 2 * np.bincount(of, minlength=batch.num_rows), pa.int64()), pa.array(found, pa.list_(pa.string()))],
                    names=["doc_id", "h", "n_words", "runs", "items"],
                )

        parts.append(own.mapInArrow(test, "doc_id long, h long, n_words long, runs array<long>, items array<string>"))
    if n_blocks == 1:
        n_hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
        return parts[0].select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "h")
    pair = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2 - 1).cast("int")), lambda i: F.struct(F.element_at("runs", (2 * i + 1).cast("int")).alias("a"), F.element_at("runs", (2 * i + 2).cast("int")).alias("z")))
    none = F.array().cast("array<struct<a:bigint,z:bigint>>")
    every = reduce(DataFrame.unionByName, parts).withColumn("pairs", F.when(F.size("runs") > 0, pair).otherwise(none))
    merged = every.groupBy("doc_id", "h", "n_words").agg(F.array_sort(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / n_blocks).cast("int").alias("copies"))
    union = F.expr("aggregate(pairs, struct(0L as n, 0L as z), (s, p) -> struct(s.n + greatest(0L, p.z - greatest(p.a, s.z)) as n, greatest(s.z, p.z) as z), s -> s.n)")
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_words", union.alias("n_hit"), "items", "h")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark."""
    hit = contamination(docs, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h")).distinct()
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("c_row"), F.col("doc_id").alias("c_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("c_hash"))
    return own.join(hit, F.col("c_doc").eqNullSafe(F.col("c_id")) & (F.col("c_hash") == F.col("c_h")), "left_anti").select("c_row.*")


def _one(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
