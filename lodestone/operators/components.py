"""Connected components of an edge table, by hooking to the smallest neighbour and pointer jumping; all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import save


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of ``edges`` (a, b: long); label: the smallest vertex that is linked with it.

    Each round hooks every vertex to its smallest neighbour if that is smaller, follows these hooks to their roots, and
    keeps the edges between different roots. Rounds are logarithmic in the vertices, as every root that has an edge left
    is hooked in the next round or hooks another one.
    """
    labels = None
    left = save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not left.head(1):
        return edges.select(F.col("a").alias("v"), F.col("a").alias("label")).limit(0)
    while left.head(1):
        both = left.select(F.col("a").alias("v"), F.col("b").alias("to")).union(left.select(F.col("b").alias("v"), F.col("a").alias("to")))
        hooks = save(both.groupBy("v").agg(F.least(F.min("to"), F.col("v")).alias("p")), "hooks")
        while True:  # p(v) becomes p(p(v)) until nothing moves
            to = hooks.select(F.col("v").alias("j_v"), F.col("p").alias("j_p"))
            jumped = save(hooks.join(to, F.col("p") == F.col("j_v"), "left").select("v", F.coalesce("j_p", "p").alias("p"), (F.coalesce("j_p", "p") != F.col("p")).alias("moved")), "hooks")
            hooks = jumped.select("v", "p")
            if not jumped.filter("moved").head(1):
                break
        labels = hooks.select("v", F.col("p").alias("label")) if labels is None else _through(labels, hooks)
        a, b = hooks.select(F.col("v").alias("a_v"), F.col("p").alias("a_p")), hooks.select(F.col("v").alias("b_v"), F.col("p").alias("b_p"))
        left = left.join(a, F.col("a") == F.col("a_v")).join(b, F.col("b") == F.col("b_v")).filter("a_p <> b_p")
        left = save(left.select(F.least("a_p", "b_p").alias("a"), F.greatest("a_p", "b_p").alias("b")).distinct(), "edges")
    return labels


def _through(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    to = hooks.select(F.col("v").alias("h_v"), F.col("p").alias("h_p"))
    return save(labels.join(to, F.col("label") == F.col("h_v"), "left").select("v", F.coalesce("h_p", "label").alias("label")), "labels")
