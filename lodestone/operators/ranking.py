"""Candidates, versions, pairs and shares by window functions; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import dealt, save


def top_per(df: DataFrame, by: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each group before it is moved."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")).filter(F.col(name) <= n)


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row of each group with the largest ``order``, partly found before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_best"))
    return best.select(*by, "_best.*").select(*df.columns)


def pairs_within(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Unordered pairs of the rows of a group, smaller ``order`` first, as a_* and b_*."""
    a = df.select(group, *(F.col(c).alias(f"a_{c}") for c in {order, *columns}))
    b = df.select(group, *(F.col(c).alias(f"b_{c}") for c in {order, *columns}))
    return a.join(b, group).filter(F.col(f"a_{order}") < F.col(f"b_{order}"))


def hash_rank(salt: str, *parts: Column | str) -> Column:
    """What a salted order sorts by: the same everywhere, and independent of the data's order."""
    return F.sha2(F.concat_ws("\0", F.lit(salt), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def split_by_targets(df: DataFrame, by: str, key: str, targets: dict[str, float], salt: str) -> DataFrame:
    """A split for each row: in each category the salted order is cut at the cumulative shares of ``targets``."""
    order = Window.partitionBy(by).orderBy(hash_rank(salt, by, key), key)
    rows = df.withColumn("position", F.row_number().over(order)).withColumn("size", F.count("*").over(Window.partitionBy(by)))
    total, seen, split = sum(targets.values()), 0.0, None
    for name, share in targets.items():
        seen += share / total
        edge = F.col("position") <= F.round(F.col("size") * seen)
        split = F.when(edge, name) if split is None else split.when(edge, name)
    return rows.withColumn("split", F.coalesce(split, F.lit(list(targets)[-1])))


def quota(df: DataFrame, bucket: str, key: str, group: str, quotas: dict[str, int], salt: str) -> DataFrame:
    """``quotas`` rows of each bucket in salted order, each group at most once in a bucket."""
    rows = top_per(df.withColumn("_h", hash_rank(salt, bucket, key)), [bucket, group], ["_h", key], 1, "_one")
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(bucket).orderBy("_h", key)))
    most = F.lit(0)
    for name, n in quotas.items():
        most = F.when(F.col(bucket) == name, n).otherwise(most)
    return rows.filter(F.col("position") <= most).drop("_h", "_one")


def independent(df: DataFrame, key: str, anchors: str, order: list[str]) -> tuple[DataFrame, int]:
    """(key, round) of the rows that a walk in ``order`` takes if no two may share an anchor, and the number of rounds.

    All rows are judged side by side: one that comes first at all its anchors is taken, those that share an anchor with it
    leave, and the rest are judged again. With an order by hash there are about log n rounds. Each round is written to the
    shared folder; an anchor that very many rows share is one row on one side of each join. Rows without anchors are taken.
    """
    rows = save(df.select(F.col(key).alias("_key"), F.coalesce(F.array_distinct(F.array_compact(anchors)), F.array().cast(dict(df.dtypes)[anchors])).alias("_anchors"), F.struct(*order, F.col(key)).alias("_rank")), "round")
    taken, n = rows.filter(F.size("_anchors") == 0).select("_key", F.lit(0).alias("round")), 0
    rows = rows.filter(F.size("_anchors") > 0)
    while rows.head(1):
        n += 1
        at = rows.select("_key", "_rank", F.explode("_anchors").alias("_anchor"))
        firsts = at.groupBy("_anchor").agg(F.min("_rank").alias("_first"))
        beaten = at.join(firsts, "_anchor").filter(F.col("_rank") != F.col("_first")).select("_key").distinct()
        won = save(rows.join(beaten, "_key", "left_anti"), "won")
        used = won.select(F.explode("_anchors").alias("_anchor"))
        out = at.join(used, "_anchor", "left_semi").select("_key").distinct()
        rows = save(rows.join(out, "_key", "left_anti"), "round")
        taken = taken.unionByName(won.select("_key", F.lit(n).alias("round")))
    return taken.withColumnRenamed("_key", key), n


def quota_unique_anchors(df: DataFrame, bucket: str, key: str, anchors: str, quotas: dict[str, int], salt: str) -> DataFrame:
    """(bucket, key): ``quotas`` rows of each bucket, bucket after bucket in the order of ``quotas`` and in salted order
    within, so that no anchor serves twice."""
    rows = df.select(bucket, key, anchors, hash_rank(salt, bucket, key).alias("_h"))
    out, used = None, None
    for name, n in quotas.items():
        free = rows.filter(F.col(bucket) == name)
        if used is not None:
            taken = free.select(key, F.explode(anchors).alias("_anchor")).join(used, "_anchor", "left_semi").select(key).distinct()
            free = free.join(taken, key, "left_anti")
        chosen, _ = independent(free, key, anchors, ["_h"])
        # a quota's rows: the first n of those that a walk without end would take
        first = save(free.join(chosen, key).orderBy("_h", key).limit(n).select(bucket, key, anchors), "chosen")
        anchored = first.select(F.explode(anchors).alias("_anchor")).distinct()
        used = anchored if used is None else used.unionByName(anchored)
        out = first.select(bucket, key) if out is None else out.unionByName(first.select(bucket, key))
    return out if out is not None else rows.select(bucket, key).limit(0)


def earlier(df: DataFrame, same: list[str], fields: list[str], order: list[str], n: int, columns: list[str], of: Column | None = None) -> DataFrame:
    """``df`` with ``earlier``: rows before it in ``order`` with the same ``same`` that can be among its n best; null where ``of`` does not hold.

    For any score that does not fall when more of ``fields`` are equal or the row is later, with ties to the later row:
    for every set of fields the last n rows that agree on them, at most n * 2**len(fields) in all. Rows move once; there is
    no join, and a window holds n rows. A row that is found again by another set is kept once, so that the rows that the next
    window sorts stay short.
    """
    item, (rows,) = F.struct(*columns), dealt((df, same))
    for bits in range(1 << len(fields)):
        by = [*same, *(f for k, f in enumerate(fields) if bits >> k & 1)]
        last = F.collect_list(item).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1))
        last = last if of is None else F.when(of, last)
        rows = rows.withColumn("earlier", F.array_distinct(F.concat("earlier", last)) if bits else last)
    return rows
