"""Coverage grids, integrity of joins, and audits of a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(entities: DataFrame, entity: str, groups: DataFrame, group: str, rows: DataFrame) -> DataFrame:
    """(entity, group, n_documents, coverage_state) for every entity and group; both keys also name columns of ``rows``.

    The grid is a cross join with ``groups``, a closed vocabulary of a few rows.
    """
    counts = rows.groupBy(entity, group).agg(F.count("*").alias("n"))
    cells = entities.select(entity).distinct().crossJoin(F.broadcast(groups.select(group).distinct()))
    n = F.coalesce("n", F.lit(0))
    return cells.join(counts, [entity, group], "left").select(entity, group, n.alias("n_documents"), F.when(n > 0, "PRESENT").otherwise("ZERO_DOCUMENT").alias("coverage_state"))


def integrity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, issue): keys on one side alone, and keys that repeat; an empty result is a one-to-one match."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    n, m = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    issue = F.when(n == 0, "LEFT_MISSING").when(m == 0, "RIGHT_MISSING").when(n > 1, "LEFT_DUPLICATE").when(m > 1, "RIGHT_DUPLICATE")
    return a.join(b, key, "full_outer").select(key, issue.alias("issue")).filter("issue is not null")


def violations(df: DataFrame, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """(rule, key, message) for every row and rule whose condition holds; one pass over the table for all rules.

    A condition that is null does not hold.
    """
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(name).alias("rule"), F.lit(message).alias("message"))) for name, (bad, message) in rules.items())))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("v")).select("v.rule", "key", "v.message")


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unknown_keys(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``known``."""
    return df.join(known.select(F.col(known_key).alias("_known")).distinct(), F.col(key) == F.col("_known"), "left_anti")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side that the other has not."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("LEFT_ONLY")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("RIGHT_ONLY")))
