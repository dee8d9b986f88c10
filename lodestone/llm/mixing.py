"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule has the point frac(i * golden ratio) in [0, 1). Cumulative target shares cut [0, 1) into
one interval a source, so every stretch of the schedule holds each source in its share, up to a few slots. Slots are
ranked per source; rank r takes block r mod B of the source's B blocks, which are equal runs of words in a shuffled
order of its documents. Ranks and positions are two-level sums: totals of small hash buckets, then sums inside a
bucket. So no task ever holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import save

#: Words in one slot.
BLOCK_WORDS = 64
#: Times that a document's words may be taken at most.
MOST_REPEATS = 3
#: Slots of one stretch of the schedule, and documents in one bucket (about), within which a window runs.
STRETCH, BUCKET = 20_000, 4_000
#: The golden ratio in 31 bits; odd, so 2**31 slots visit every point once.
_GOLDEN, _ONE = 1327217885, 1 << 31
RESULT = ["doc_id", "size", "source_size", "target", "taken", "h"]
_SPACE = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_SPACE)), F.lit(0)).cast("long")


#: Up to so many sources, they are broadcast and stand in expressions; more are joined. Either way the driver has the sum and
#: the target of each source, some hundred bytes.
SOURCES = 1024


def targets(sizes: list[tuple[str | None, int]], weights: list[float] | None = None, most: float = MOST_REPEATS) -> list[float]:
    """Target words of each (source, size), in the order given: shares of all words by weight, at most ``most`` sizes.

    What a capped source leaves over goes to the others by weight until none is above its cap. Weights are 1, 2, 3,
    repeating, unless given. Sources without words get 0.
    """
    weights = weights or [1 + k % 3 for k in range(len(sizes))]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(n for _, n in sizes))
    while free and left > 0:
        by = left / sum(weights[k] for k in free)
        above = {k for k in free if weights[k] * by >= most * sizes[k][1]}
        if not above:
            for k in free:
                out[k] = weights[k] * by
            break
        for k in above:
            out[k] = float(most * sizes[k][1])
            left -= out[k]
        free -= above
    return out


def _placed(rows: DataFrame, by: str, bucket: Column, order: list[str], amount: str, to: str) -> DataFrame:
    """``to``: the sum of ``amount`` over the rows of ``by`` that come before; in two levels."""
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy(F.col(by).alias("s_by"), F.col("bucket").alias("s_bucket")).agg(F.sum(amount).alias("s"))
    before = Window.partitionBy("s_by").orderBy("s_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inside = Window.partitionBy(by, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(sums, (F.col(by) == F.col("s_by")) & (F.col("bucket") == F.col("s_bucket")))
        .withColumn(to, F.col("ahead") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("s_by", "s_bucket", "ahead", "bucket")
    )


def mix(docs: DataFrame, weights: list[float] | None = None, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, h) for each row of ``docs``.

    taken: the words that the schedule takes from the row, repeats counted; at most three times its size. A source's
    rows together take its target, rounded. h: a hash of doc_id and text, by which the documents are shuffled. Null text has no words; null is a source of its own, the last one. Rows
    without words get taken 0. Repeated rows are rows of their own. An empty table gives an empty table. There may be
    any number of sources.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = save(docs.select("doc_id", "source", F.xxhash64(F.lit(seed), text, "doc_id").alias("h"), n_words(F.col("text")).alias("size")), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    per = sorted(((r["source"], r["n"]) for r in sums), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    exact = targets(per, weights)
    want = [round(x) for x in exact]
    info = spark.createDataFrame([(k, s, n, t, w) for k, ((s, n), t, w) in enumerate(zip(per, exact, want, strict=True))], "k int, name string, source_size long, target double, want long")
    rows = rows.join(_few(info, len(per)), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    if not sum(want):
        return rows.withColumn("taken", F.lit(0).cast("long")).select(*RESULT)

    times = block_uses(spark, per, want, block_words)
    n_buckets = max(1, rows.count() // BUCKET)
    at = _placed(rows.filter("size > 0"), "k", F.pmod(F.col("h"), F.lit(n_buckets)), ["h", "doc_id", "size"], "size", "at")
    blocks = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))))
    first = F.col("block") * block_words
    low, high = F.greatest(F.col("at"), first), F.least(F.col("at") + F.col("size"), first + block_words)
    # whole uses of the block, and what its last, shorter use has of the row
    part = (high - low) * F.col("uses") + F.greatest(F.lit(0), F.least(high, first + F.col("rest")) - low)
    taken = (
        blocks.join(times.withColumnsRenamed({"k": "t_k", "block": "t_block"}), (F.col("k") == F.col("t_k")) & (F.col("block") == F.col("t_block")), "left")
        .groupBy("k", "at", "doc_id", "size", "source_size", "target", "h")
        .agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("taken"))
    )
    return taken.select(*RESULT).unionByName(rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*RESULT))


def schedule(spark, per: list[tuple[str | None, int]], want: list[int], block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, k, rank): which source each slot takes, ranked per source."""
    total, edges, seen = sum(want), [], 0
    for w in want:
        seen += w
        edges.append(seen / total)
    edges[-1] = 2.0
    n = sum(-(-w // block_words) for w in want)
    point = (F.col("slot") % _ONE) * F.lit(_GOLDEN) % _ONE / F.lit(float(_ONE))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("one", F.lit(1))
    slots = _of_intervals(slots, edges)
    return _placed(slots.select("slot", "k", "one"), "k", F.floor(F.col("slot") / STRETCH), ["slot"], "one", "rank").drop("one")


def _few(table: DataFrame, n: int) -> DataFrame:
    """A table of one row a source, broadcast where they are few."""
    return F.broadcast(table) if n <= SOURCES else table


def _of_intervals(slots: DataFrame, edges: list[float]) -> DataFrame:
    """``slots`` with k: how many edges are not above the point."""
    if len(edges) <= SOURCES:
        cut = F.array(*(F.lit(e) for e in edges))
        return slots.withColumn("k", F.aggregate(cut, F.lit(0), lambda acc, e: acc + (e <= F.col("point")).cast("int")))
    # each interval in the bins that it meets; a point's bin has its interval, and few others
    n, bins, at = len(edges), [], 0.0
    for k, edge in enumerate(edges):
        bins += [(b, k, at, edge) for b in range(int(at * n), min(n - 1, int(edge * n)) + 1)] if edge > at else []
        at = max(at, edge)
    table = slots.sparkSession.createDataFrame(bins, "bin int, k int, low double, high double")
    binned = slots.withColumn("bin", F.least(F.lit(n - 1), F.floor(F.col("point") * n)).cast("int"))
    return binned.join(table, "bin").filter((F.col("low") <= F.col("point")) & (F.col("point") < F.col("high"))).drop("bin", "low", "high")


def block_uses(spark, per: list[tuple[str | None, int]], want: list[int], block_words: int = BLOCK_WORDS) -> DataFrame:
    """(k, block, uses, rest): how often each block is taken whole, and the words of its last, shorter use.

    A source's slots beyond its target are dropped. One that the schedule leaves short gets its missing ranks at the
    end, so that every source meets its target exactly.
    """
    slots = schedule(spark, per, want, block_words)
    reached = {r["k"]: r["n"] for r in slots.groupBy("k").agg(F.count("*").alias("n")).collect()}
    shape = spark.createDataFrame([(k, w, n) for k, ((_, n), w) in enumerate(zip(per, want, strict=True))], "s_k int, want long, words long")
    needed = [w // n * -(-n // block_words) + -(-(w % n) // block_words) if w else 0 for (_, n), w in zip(per, want, strict=True)]
    late = [(k, reached.get(k, 0), most - 1) for k, most in enumerate(needed) if reached.get(k, 0) < most]
    ranks = slots.select("k", "rank")
    if late:
        tail = spark.createDataFrame(late, "k int, first long, last long")
        ranks = ranks.unionByName(tail.select("k", F.explode(F.sequence("first", "last")).alias("rank")))
    n_blocks = F.ceil(F.col("words") / block_words)
    ranked = (
        ranks.join(_few(shape, len(per)), F.col("k") == F.col("s_k"))
        .withColumn("block", F.col("rank") % n_blocks)
        .withColumn("start", F.floor(F.col("rank") / n_blocks) * F.col("words") + F.col("block") * block_words)
        .withColumn("length", F.least(F.lit(block_words), F.col("words") - F.col("block") * block_words))
        .withColumn("part", F.least(F.col("length"), F.col("want") - F.col("start")))
        .filter("part > 0")
    )
    return ranked.groupBy("k", "block").agg(F.sum((F.col("part") == F.col("length")).cast("long")).alias("uses"), F.max(F.when(F.col("part") < F.col("length"), F.col("part")).otherwise(0)).alias("rest"))


def repeated(docs: DataFrame, weights: list[float] | None = None, seed: int = 17) -> DataFrame:
    """The mix as documents: each row as often as the schedule takes it, with the columns of ``docs``.

    A row that the schedule cuts counts as taken whole. Rows without words are in no slot. Rows alike in doc_id and
    text share their uses among them.
    """
    uses = mix(docs, weights, seed=seed).filter("taken > 0").groupBy(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h"))
    uses = uses.agg(F.collect_list(F.ceil(F.col("taken") / F.col("size")).cast("int")).alias("m_uses"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("m_row"), F.col("doc_id").alias("m_doc"), F.xxhash64(F.lit(seed), F.coalesce("text", F.lit("")), "doc_id").alias("m_hash"))
    own = own.join(uses, F.col("m_doc").eqNullSafe(F.col("m_id")) & (F.col("m_hash") == F.col("m_h")))
    own = own.withColumn("m_at", F.row_number().over(Window.partitionBy("m_id", "m_h").orderBy(F.xxhash64("m_row"))))
    return own.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.try_element_at("m_uses", "m_at")))).select("m_row.*")
