"""Quality classifier: supervised subword embeddings. Every word, pair of neighbouring words and character n-gram of a
text has a learned vector, found by a hash; their mean goes through a linear layer and a softmax. Vectors and layer are
trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.

A mean goes through a linear layer as well before as after it is taken: to score, each feature needs only its vector's
product with the layer, one number a class. These numbers are what is broadcast (BUCKETS a class), and a text is scored
by one gather and one sum over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words
from lodestone.llm.common import column, flat, in_rows, lists, release, save

#: Hash places of features, numbers in a vector, bytes in character n-grams (with the marks of a word's two ends).
BUCKETS, WIDTH, GRAMS = 1 << 18, 16, (3, 4)
#: Labelled rows that are learned from, at most: those of smallest hash. Passes over them, and the first step.
SAMPLE, EPOCHS, RATE = 8192, 8, 4.0
#: Bytes of texts that are worked on at once, unless one text is longer.
BYTES = 1_000_000
_START, _END = np.uint8(2), np.uint8(3)
_PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Model:
    """What a feature adds to the log-odds of each class, classes in order; and the classes' shares in the sample."""

    classes: list[int]
    adds: np.ndarray
    shares: np.ndarray


def _place(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h * _PRIMES[kind]) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, text) of all features of the texts, kind by kind. Every text ends with a feature of its own kind, so that
    an empty one has one too."""
    n = len(offsets) - 1
    yield np.zeros(n, np.int32), np.arange(n)
    starts, ends, text = words.bounds(data, offsets, words.NOT_SPACE)
    if not len(starts):
        return
    h = words.hashes(data, starts, ends, None)
    yield _place(h, 0), text
    pair = np.flatnonzero(text[1:] == text[:-1])
    yield _place(words.mix(h[pair] * _PRIMES[1] + h[pair + 1]), 1), text[pair]
    # the words with marks around each, one after another
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(size), dtype=np.int32), size)
    marked = np.empty(at[-1], np.uint8)
    marked[at[:-1]], marked[at[1:] - 1] = _START, _END
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    marked[inner] = data[np.cumsum(inside[:-1]).astype(bool)]
    for kind, k in enumerate(GRAMS, 2):
        if len(marked) < k:
            continue
        key = np.zeros(len(marked) - k + 1, np.uint64)
        for j in range(k):
            key |= marked[j : len(key) + j].astype(np.uint64) << np.uint64(8 * j)
        whole = word[k - 1 :] == word[: len(key)]
        yield _place(words.mix(key[whole]), kind), text[word[: len(key)][whole]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, label, text) to (h, label, places, shares): each distinct feature of the text with its share of all."""
    for batch in in_rows(batches, "text", BYTES):
        data, offsets = flat(column(batch, "text"))
        place, text = (np.concatenate(x) for x in zip(*features(data, offsets), strict=True))
        key, n = np.unique(text.astype(np.int64) * BUCKETS + place, return_counts=True)
        of = key // BUCKETS
        sizes, total = np.bincount(of, minlength=batch.num_rows), np.bincount(text, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "h"), column(batch, "label"), lists((key % BUCKETS).astype(np.int32), sizes, pa.int32()), lists((n / total[of]).astype(np.float32), sizes, pa.float32())],
            names=["h", "label", "places", "shares"],
        )
    release()


def descend(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, seed: int = 1) -> np.ndarray:
    """Train vectors and layer on (places, shares, class) rows; the product of both, by place and class."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, n_classes), np.float32)
    steps = EPOCHS * len(rows)
    for step, i in enumerate(np.concatenate([rng.permutation(len(rows)) for _ in range(EPOCHS)])):
        places, shares, own = rows[i]
        rate = np.float32(RATE * (1 - step / steps))
        mean = shares @ vectors[places]
        odds = mean @ layer
        off = np.exp(odds - odds.max())
        off /= off.sum()
        off[own] -= 1
        back = layer @ off
        layer -= rate * np.outer(mean, off)
        vectors[places] -= (rate * shares)[:, None] * back
    return vectors @ layer


def learn(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> Model:
    """Train on the texts of ``docs`` whose key has a label in ``labels``.

    At most SAMPLE rows are learned from, those of smallest hash of key and text, whole; equal rows count once. Null
    keys and labels, and keys with several labels that differ, teach nothing. Without any label the model knows no class.
    """
    labels = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k"))
    labels = labels.agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most")).filter("label = most").drop("most")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), text.alias("text"))
    # by the hash of the key first, so that only texts of rows that can be in the sample are worked on
    first = rows.select("k").distinct().join(labels, "k").orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    chosen = rows.join(F.broadcast(first), "k").withColumn("h", F.xxhash64("k", "text"))
    sample = save(chosen.select("h", "label", "text").mapInArrow(_counted, "h long, label int, places array<int>, shares array<float>"), "quality_features")
    sample = sample.dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).coalesce(1)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own = [], []
        for batch in batches:
            own += column(batch, "label").to_pylist()
            places, shares = column(batch, "places"), column(batch, "shares")
            rows += [(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(places, shares, strict=True)]
        classes = sorted(set(own))
        if not classes:
            return
        to = {c: i for i, c in enumerate(classes)}
        adds = descend([(*x, to[c]) for x, c in zip(rows, own, strict=True)], len(classes))
        share = np.bincount([to[c] for c in own]) / len(own)
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), pa.array(share), pa.array([adds[:, i].tobytes() for i in range(len(classes))], pa.binary())], names=["label", "share", "adds"])

    found = sorted(sample.mapInArrow(trained, "label int, share double, adds binary").collect(), key=lambda r: r["label"])  # a row a class
    return Model([r["label"] for r in found], np.array([np.frombuffer(r["adds"], np.float32) for r in found]), np.array([r["share"] for r in found]))


def score(docs: DataFrame, model: Model, label: int = 1, key: str = "doc_id") -> DataFrame:
    """(key, score): how likely each whole text is of class ``label``, from 0 to 1; null counts as empty.

    A model that does not know the class gives 0, and one that knows no class at all 0.5.
    """
    kind = f"{key} {dict(docs.dtypes)[key]}, score double"
    rows = docs.select(F.col(key), "text")
    if len(model.classes) < 2:
        alone = 0.5 if not model.classes else float(model.classes[0] == label)
        return rows.select(F.col(key), F.lit(alone).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in in_rows(batches, "text", BYTES):
            data, offsets = flat(column(batch, "text"))
            n = batch.num_rows
            total, size = np.zeros((len(m.classes), n)), np.zeros(n)
            for place, text in features(data, offsets):
                size += np.bincount(text, minlength=n)
                for out, adds in zip(total, m.adds, strict=True):
                    out += np.bincount(text, adds[place], minlength=n)
            odds = total / size
            odds = np.exp(odds - odds.max(0))
            p = odds[m.classes.index(label)] / odds.sum(0) if label in m.classes else np.zeros(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=[key, "score"])
        release()

    return rows.mapInArrow(scored, kind)
