"""Language-model scoring by a hidden Markov model over word classes.

The MOST_FREQUENT commonest tokens are classes of their own; all others share CLASSES classes by a hash. A hidden Markov
model with STATES states gives the probability of a text's class sequence by the scaled forward recursion, exactly and
over the whole text; the smoothed unigram counts give the probability of each token within its class. The product is
the model's probability of the text.

Counts come from all training texts: unigram counts by one aggregation, and Baum-Welch counts, a fixed number of them,
summed over partitions once a step. Training is incremental: the texts are dealt to SLICES by a hash, each step renews the
counts of one slice under the present model, and the next model follows from the latest counts of all slices (Neal and
Hinton's incremental variant, whose steps are as sound as whole rounds). Words are known by 64-bit hashes. Their counts
reach the texts in two ways: up to HEAD of the commonest are broadcast, a fixed bound; the rest is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, flat, in_rows, lists, save
from lodestone.llm.words import NOT_SPACE, bounds, first_of_text, hashes, mix

#: A sweep counts every training text once, slice by slice. Training ends when a sweep adds less than GAIN to the log10
#: likelihood of a token, whatever the size of the input, or after SWEEPS sweeps.
STATES, MOST_FREQUENT, CLASSES, SLICES, SWEEPS, GAIN = 8, 1024, 1024, 4, 12, 1e-3
#: Tokens' worth of class weights that each state's emissions are smoothed by.
PRIOR = 1000
#: Chance that a state stays, before training.
STAY = 0.97
N_CLASSES = MOST_FREQUENT + CLASSES
#: Words whose counts are broadcast at most, 16 bytes each.
HEAD = 1 << 20
#: Bands of counts a power of two, and parts of one band, by which the head is chosen.
BANDS, PARTS = 16, 1024
#: Tokens that training counts together, and tokens on both sides that it reads besides for their context: each token and
#: each step of a text counts once, however long the text is. Scoring never cuts.
STRETCH, AROUND = 256, 64
#: Stretches that training counts at once.
COLUMNS = 4096
#: Tokens held at once by the forward recursion.
HELD = 3_000_000
END = np.uint64(0x5EED0FE4D0F7E875)
SMOOTH = 0.5


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end token, and the texts' first tokens (and the count)."""
    data, offsets = flat(texts)
    starts, ends, text = bounds(data, offsets, NOT_SPACE)
    first = first_of_text(text, len(texts))
    return np.insert(hashes(data, starts, ends), first[1:], END), first + np.arange(len(first))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): how often each token occurs; summed in the task, then over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            w = np.concatenate([x[0] for x in held])
            keys, at = np.unique(w, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, weights=np.concatenate([x[1] for x in held])).astype(np.int64))], names=["w", "c"])

        for batch in in_rows(batches, "text"):
            held.append(np.unique(_tokens(column(batch, "text"))[0], return_counts=True))
            size += len(held[-1][0])
            if size > 1_500_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Counts:
    """Unigram counts of the training texts: the whole table, its sums, and the head that is broadcast."""

    def __init__(self, docs: DataFrame) -> None:
        self.table = save(_word_counts(docs), "counts")
        self.n, self.v = (x or 0 for x in self.table.agg(F.sum("c"), F.count("*")).first())
        top = self.table.orderBy(F.col("c").desc(), "w").limit(MOST_FREQUENT).collect()
        self.top, order = np.unique(np.array([r["w"] for r in top], np.int64).view(np.uint64), return_index=True)
        self.top_counts = np.array([r["c"] for r in top], float)[order]
        head = self.table.filter(self._in_head([r["w"] for r in top])).toArrow()
        w, c = head.column("w").to_numpy().view(np.uint64), head.column("c").to_numpy()
        order = np.argsort(w)
        self.words, self.counts = w[order], c[order]
        # class totals of the smoothed counts, each class with one unseen word
        rows = self.table.withColumn("k", F.pmod("w", F.lit(CLASSES))).groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
        self.total, types = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in rows:
            self.total[r["k"]], types[r["k"]] = r["c"], r["v"]
        k = np.mod(self.top.view(np.int64), CLASSES)
        np.subtract.at(self.total, k, self.top_counts)
        np.subtract.at(types, k, 1)
        self.total += SMOOTH * (types + 1)

    def _in_head(self, top: list[int]) -> Column:
        """Whether a row of the table is of the head: the highest bands of counts, and of the band that does not fit whole
        as many of PARTS parts by hash as fit; ``top`` besides. Kept as ``head``."""
        band = F.floor(F.log2("c") * BANDS).cast("int")
        part = F.pmod(F.xxhash64("w"), F.lit(PARTS)).cast("int")
        room, least, parts = HEAD, 0, 0
        for r in self.table.groupBy(band.alias("band")).count().orderBy(F.col("band").desc()).collect():  # at most 64 * BANDS rows
            if r["count"] > room:
                least = r["band"] + 1
                for p in self.table.filter(band == r["band"]).groupBy(part.alias("part")).count().orderBy("part").collect():
                    if (room := room - p["count"]) < 0:
                        break
                    parts = p["part"] + 1
                break
            room -= r["count"]
        self.head = (band >= least) | ((band == least - 1) & (part < parts)) | F.col("w").isin(top)
        return self.head

    def small(self) -> dict:
        """What a task needs, of bounded size."""
        return {"words": self.words, "counts": self.counts, "top": self.top, "total": self.total}

    def class_weights(self) -> np.ndarray:
        out = np.concatenate([self.top_counts + SMOOTH, np.full(MOST_FREQUENT - len(self.top), SMOOTH), self.total])
        return out / out.sum()


def _coded(docs: DataFrame, counts: Counts) -> DataFrame:
    """Each row of (row, doc_id, held_out, slice, text) with its tokens' classes, and what the head knows of their counts.

    codes: 16-bit classes. base: sum of log10(count + 0.5) over tokens in the head; inside: of those log10 of the
    probability within the class; rest: hashes of the tokens that the head does not know.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts.small())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, top, total = (held.value[k] for k in ("words", "counts", "top", "total"))
        log_known, log_total = np.log10(known + SMOOTH), np.log10(total)
        for batch in in_rows(batches, "text"):
            w, first = _tokens(column(batch, "text"))
            size = np.diff(first)
            of = np.repeat(np.arange(len(size)), size)
            keys, back = np.unique(w, return_inverse=True)  # a batch repeats its words
            at = np.minimum(np.searchsorted(words, keys), max(0, len(words) - 1))
            head = words[at] == keys if len(words) else np.zeros(len(keys), bool)
            own = np.minimum(np.searchsorted(top, keys), max(0, len(top) - 1))
            is_top = top[own] == keys if len(top) else np.zeros(len(keys), bool)
            bucket = np.mod(keys.view(np.int64), CLASSES)
            codes = np.where(is_top, own, MOST_FREQUENT + bucket).astype("<u2")
            log_c = np.where(head, log_known[at] if len(words) else 0.0, 0.0)
            inside = np.where(head & ~is_top, log_c - log_total[bucket], 0.0)
            sums = [np.bincount(of, weights=x[back], minlength=len(size)) for x in (log_c, inside, head.astype(float))]
            rest = ~head[back]
            raw = codes[back].tobytes()
            yield pa.RecordBatch.from_arrays(
                [column(batch, c) for c in ("row", "doc_id", "held_out", "slice")]
                + [pa.array(size), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array([raw[2 * a : 2 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())]
                + [lists(w[rest].view(np.int64), np.bincount(of[rest], minlength=len(size)), pa.int64())],
                names=["row", "doc_id", "held_out", "slice", "n_tokens", "n_head", "base", "inside", "codes", "rest"],
            )

    return docs.mapInArrow(code, "row long, doc_id long, held_out boolean, slice int, n_tokens long, n_head long, base double, inside double, codes binary, rest array<long>")


class Model:
    """Start, step and emission probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def first(cls, weights: np.ndarray) -> Model:
        """Each state has the class weights, moved by a fixed hash, and mostly stays."""
        noise = mix(np.arange(STATES * len(weights), dtype=np.uint64) + np.uint64(1)).astype(float) / 2**64
        emit = weights * (0.02 + noise.reshape(STATES, -1)) ** 2
        step = np.full((STATES, STATES), (1 - STAY) / STATES) + STAY * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), step, emit / emit.sum(1, keepdims=True))

    def expected(self, obs: np.ndarray, size: np.ndarray, pre: np.ndarray, core: np.ndarray) -> np.ndarray:
        """Expected counts (start, steps, emissions, flat) and log10 likelihood of sequences: obs has a column each, sizes fall.

        Of each sequence the tokens pre to pre + core count, and the steps that lead to them; the others are context.
        """
        steps, n_all = obs.shape
        emit, step = np.ascontiguousarray(self.emit.T, np.float32), self.step.astype(np.float32)
        alive = np.searchsorted(-size, -np.arange(steps), side="left").tolist()  # sequences longer than t
        place = np.arange(steps)[:, None]
        inside = (place >= pre) & (place < pre + core)
        alpha, scale = np.zeros((steps, n_all, STATES), np.float32), np.ones((steps, n_all, 1), np.float32)
        a = np.where((pre == 0)[:, None], self.start, 1 / STATES).astype(np.float32)
        for t, n in enumerate(alive):
            a = (a[:n] if t == 0 else a[:n] @ step) * emit[obs[t, :n]]
            scale[t, :n, 0] = a.sum(1)
            a = alpha[t, :n] = a / scale[t, :n]
        beta, back = np.ones((n_all, STATES), np.float32), np.ascontiguousarray(step.T)
        pairs, emitted = np.zeros((STATES, STATES)), np.zeros((N_CLASSES, STATES))
        for t in range(steps - 1, 0, -1):
            n = alive[t]
            ahead = emit[obs[t, :n]] * beta[:n] / scale[t, :n]
            pairs += alpha[t - 1, :n].T @ (ahead * inside[t, :n, None])
            beta[:n] = ahead @ back
            alpha[t - 1, :n] *= beta[:n]  # from here on the chance of each state
        seen, g = obs[inside], alpha[inside]
        for k in range(STATES):
            emitted[:, k] = np.bincount(seen, weights=g[:, k], minlength=N_CLASSES)
        fit = np.log10(scale[:, :, 0][inside], dtype=float).sum()
        return np.concatenate([alpha[0][pre == 0].sum(0, dtype=float), (pairs * self.step).ravel(), emitted.T.ravel(), [fit]])

    def better(self, counts: np.ndarray, weights: np.ndarray) -> Model:
        """The model of the summed counts, smoothed by the class weights so that nothing is impossible."""
        start, step, emit = np.split(counts[:-1], [STATES, STATES + STATES**2])
        start, step, emit = start + 1, step.reshape(STATES, STATES) + 1, emit.reshape(STATES, -1) + PRIOR * weights
        return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log10(self, codes: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each sequence by the scaled forward recursion, all sequences at once."""
        size = np.array([len(x) for x in codes])
        order = np.argsort(-size, kind="stable")
        every, first = np.concatenate(codes), (np.cumsum(size) - size)[order]
        size, emit = size[order], np.ascontiguousarray(self.emit.T)
        out, a = np.zeros(len(codes)), np.broadcast_to(self.start, (len(codes), STATES))
        alive = np.searchsorted(-size, -np.arange(size[0]), side="left")
        for t, n in enumerate(alive.tolist()):
            a = (a[:n] if t == 0 else a[:n] @ self.step) * emit[every[first[:n] + t]]
            total = a.sum(1)
            out[:n] += np.log10(total)
            a = a / total[:, None]
        back = np.empty_like(out)
        back[order] = out
        return back


def _expected(model: Model, raw: pa.Array) -> np.ndarray:
    """Expected counts of texts given as 16-bit classes, stretch by stretch with the tokens around."""
    data, offsets = flat(raw)
    codes, offsets = np.append(np.frombuffer(data.tobytes(), "<u2"), 0).astype(np.int64), offsets // 2
    n = -(-np.diff(offsets) // STRETCH)
    of = np.repeat(np.arange(len(n)), n)
    begin = offsets[:-1][of] + STRETCH * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    core = np.minimum(STRETCH, offsets[1:][of] - begin)
    pre = np.minimum(AROUND, begin - offsets[:-1][of])
    size = pre + core + np.minimum(AROUND, offsets[1:][of] - begin - core)
    order = np.argsort(-size, kind="stable")
    total = np.zeros(STATES + STATES**2 + STATES * N_CLASSES + 1)
    for a in range(0, len(order), COLUMNS):
        at = order[a : a + COLUMNS]
        place = (begin - pre)[at] + np.arange(size[at[0]])[:, None]
        total += model.expected(codes[np.minimum(place, len(codes) - 1)], size[at], pre[at], core[at])
    return total


def train(coded: DataFrame, weights: np.ndarray, sweeps: int = SWEEPS) -> Model:
    """Incremental Baum-Welch over all rows of ``coded`` whose slice is not negative; Spark sums a fixed number of counts."""
    spark, model = coded.sparkSession, Model.first(weights)
    n = STATES + STATES**2 + STATES * N_CLASSES + 1
    latest: dict[int, np.ndarray] = {}
    before = -np.inf
    for step in range(sweeps * SLICES):
        held = spark.sparkContext.broadcast((model.start, model.step, model.emit))

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            now, total = Model(*held.value), None
            for batch in in_rows(batches, "codes", 600_000):
                got = _expected(now, column(batch, "codes"))
                total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])

        texts = coded.filter(F.col("slice") == step % SLICES).select("codes")
        rows = texts.mapInArrow(expect, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        counts = np.zeros(n)
        counts[rows.column("i").to_numpy()] = rows.column("x").to_numpy()
        latest[step % SLICES] = counts
        total = sum(latest.values())
        if total.any():
            model = model.better(total, weights)
        if step % SLICES == SLICES - 1:  # the end of a sweep
            n_tokens = total[STATES + STATES**2 : -1].sum()
            if n_tokens == 0 or total[-1] - before < GAIN * n_tokens:
                break
            before = total[-1]
    return model


def score(docs: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    held_out: a column; rows where it holds are scored but not learned from. Null text is empty, so it has the end token
    alone. base_score: the sum of log10 of the smoothed unigram probabilities; score: log10 of the model's probability
    of the whole text. Without training texts every token is unseen. Rows that repeat, or have a null doc_id, are rows
    of their own. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = Counts(own.filter(~F.col("held_out")))
    n, v = counts.n, counts.v
    part = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES))).cast("int")
    rows = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", part.alias("slice"), "text")
    coded = save(_coded(rows, counts), "coded", "slice")
    # the tail of the vocabulary: one row for each word of a text, joined with the counts
    tail = coded.select("row", F.explode("rest").alias("w")).groupBy("row", "w").agg(F.count("*").alias("times"))
    known = counts.table.filter(~counts.head).select(F.col("w").alias("t_w"), "c")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    classes = spark.createDataFrame([(k, float(x)) for k, x in enumerate(np.log10(counts.total))], "b int, total double")  # CLASSES rows
    bucket = F.col("total")
    tail = (
        tail.join(known, F.col("w") == F.col("t_w"), "left")
        .join(F.broadcast(classes), F.pmod("w", F.lit(CLASSES)) == F.col("b"))
        .groupBy(F.col("row").alias("t_row"))
        .agg(F.sum(F.col("times") * log_c).alias("t_base"), F.sum(F.col("times") * (log_c - bucket)).alias("t_inside"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("t_known"))
    )
    model = train(coded, counts.class_weights())
    held = spark.sparkContext.broadcast((model.start, model.step, model.emit))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wait, size = Model(*held.value), [], 0

        def done() -> pa.RecordBatch:
            codes = [np.frombuffer(x.as_buffer(), "<u2") for b in wait for x in column(b, "codes")]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([column(b, "row") for b in wait]), pa.array(now.log10(codes))], names=["f_row", "forward"])

        for batch in in_rows(batches, "codes", 2 * HELD):
            wait.append(batch)
            size += batch.num_rows + column(batch, "codes").nbytes // 2
            if size >= HELD:
                yield done()
                wait, size = [], 0
        if wait:
            yield done()

    paths = coded.select("row", "codes").mapInArrow(forward, "f_row long, forward double")
    base = F.col("base") + F.coalesce("t_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + SMOOTH * (v + 1))))
    return (
        coded.drop("codes", "rest")
        .join(paths, F.col("row") == F.col("f_row"))
        .join(tail, F.col("row") == F.col("t_row"), "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_head") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            base.alias("base_score"),
            (F.col("forward") + F.col("inside") + F.coalesce("t_inside", F.lit(0.0))).alias("score"),
        )
    )
