"""Facts from contract tables: rows against rules, the best table, the last row of each metric, values with status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import stable_id
from lodestone.functions.text import find_date, normal_label, normal_report_family
from lodestone.functions.values import metric_unit, value_status
from lodestone.functions.vocabulary import CORRECTED_DAY, CORRECTED_NAME, CORRECTED_REASON, METRIC_RULES
from lodestone.sources.shared import dealt, save


def table_rows(documents: DataFrame) -> DataFrame:
    """(document_id, node_id, table_at, row_at, value, labels, n_rows) of documents (document_id, nodes): the last cell is the value.

    n_rows: rows of the table that have a cell.
    """
    nodes = documents.select("document_id", F.posexplode("nodes").alias("table_at", "node")).filter("node.kind = 'table'")
    rows = nodes.select("document_id", F.col("node.node_id").alias("node_id"), "table_at", F.size(F.filter("node.normalized_rows", lambda r: F.size(r) > 0)).alias("n_rows"), F.posexplode("node.normalized_rows").alias("row_at", "cells"))
    cells = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    rows = rows.withColumn("cells", cells).filter(F.size("cells") > 0)
    return rows.select("document_id", "node_id", "table_at", "row_at", F.element_at("cells", -1).alias("value"), F.slice("cells", F.lit(1), F.size("cells") - 1).alias("labels"), "n_rows")


def matched_rows(rows: DataFrame) -> DataFrame:
    """Rows with each metric whose rule their joined label, or one label alone, satisfies; the rules are eight literals. A row
    stands once for each label that does.

    Labels repeat from table to table, so each different one is brought to its form and held against the rules once. Those
    that satisfy a rule are written before they are joined: Spark sees how few they are, and rows move only if they are many.
    """
    one = rows.withColumn("raw", F.explode(F.concat(F.array(F.array_join("labels", " ")), "labels")))
    label = normal_label(F.col("raw"))
    kinds = one.select("raw").distinct().select("raw", label.alias("label"))
    hits = F.array_compact(F.array(*(F.when(F.col("label").rlike(p), F.struct(F.lit(m).alias("metric_code"), F.lit(t).alias("value_type"))) for m, t, p in METRIC_RULES)))
    kinds = save(kinds.select("raw", F.explode(hits).alias("m")).select("raw", "m.*"), "labels")
    return one.join(kinds, "raw").drop("raw", "labels")


def facts(documents: DataFrame, last: bool = True) -> DataFrame:
    """(document_id, metric_code, status, certainty, values, confidence, fact_id, evidence) of each document's best table.

    The best table matches most rules, then has most rows, then comes first. A metric's last matching row counts, or its
    first if ``last`` is false. Rows that match move once, by document, and are sorted once for all windows.
    """
    (hits,) = dealt((matched_rows(table_rows(documents)), ["document_id"]), rows=len(METRIC_RULES) * documents.count())
    table = Window.partitionBy("document_id", "table_at", "node_id")
    by_row = Window.partitionBy("document_id", "table_at", "node_id", "metric_code").orderBy(F.col("row_at").desc() if last else F.col("row_at"))
    hits = hits.withColumn("n", F.row_number().over(by_row)).filter("n = 1").withColumn("n_rules", F.count("*").over(table))
    place = F.struct("n_rules", "n_rows", (-F.col("table_at")).alias("table_at"), "node_id")
    chosen = hits.withColumn("best", F.max(place).over(Window.partitionBy("document_id"))).filter(place == F.col("best"))
    reason = F.max((F.col("metric_code") == "WITHHELD_REASON") & ~F.col("value").rlike("^[-–—]?$")).over(Window.partitionBy("document_id"))
    chosen = chosen.withColumn("withheld", reason).withColumn("v", value_status(F.col("value"), F.col("value_type"), F.col("metric_code"), F.col("withheld")))
    fact = stable_id("fact", "document_id", "metric_code", F.col("node_id"), F.col("row_at"))
    return chosen.select("document_id", "metric_code", "value_type", "v.*", metric_unit(F.col("metric_code")).alias("of_unit"), F.when(F.col("n_rules") >= 6, 0.98).otherwise(0.9).alias("confidence"), fact.alias("fact_id"), stable_id("evidence", "document_id", F.col("node_id"), F.col("row_at")).alias("evidence_id"), F.col("value").alias("quote"), "node_id", "row_at").select("*", "of_unit.*").drop("of_unit")


def correction_references(documents: DataFrame) -> DataFrame:
    """(document_id, ref_day, ref_family, reason) from the rows of correction tables; of several the last counts."""
    rows = table_rows(documents).withColumn("label", F.regexp_replace(F.array_join("labels", " "), r"(?U)\s+", ""))
    place = F.struct("table_at", "row_at")
    last = lambda ok, value: F.max_by(F.when(ok, value), F.when(ok, place))
    is_day = F.col("label").rlike(CORRECTED_DAY)
    is_name = ~is_day & F.col("label").rlike(CORRECTED_NAME)
    is_reason = ~is_day & ~is_name & F.col("label").rlike(CORRECTED_REASON)
    return rows.groupBy("document_id").agg(last(is_day, find_date(F.col("value"))).alias("ref_day"), last(is_name, normal_report_family(F.col("value"))).alias("ref_family"), last(is_reason, F.col("value")).alias("reason"))
