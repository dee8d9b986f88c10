"""Work for reviewers: links of gold questions to evidence, termination packets, blocked questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import normal_text
from lodestone.functions.vocabulary import IDENTITY_WEIGHTS
from lodestone.operators.ranking import top_per

#: Code points shown before and after a quote, evidence rows of a termination, and what its quotes must say. Fixed values.
AROUND, MOST_EVIDENCE, TERMINATION = 160, 10, "해지"


def gold_links(links: DataFrame, evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question_id, slot_name, evidence_id, code, block_type, row, column, cell_text, excerpt, n_quotes, flags) of each link.

    links: (question_id, slot_name, evidence_id, document_id, file_id, locator, row, column); evidence: (evidence_id, document_id,
    file_id, locator, quote); blocks: (document_id, file_id, locator, block_type, text, cells: array of (row, column, text), null
    without a table). code: the first of EVIDENCE_NOT_FOUND, PROVENANCE_MISMATCH, BLOCK_NOT_FOUND, CELL_NOT_FOUND and
    QUOTE_NOT_FOUND that holds, else OK. n_quotes: evidence rows of the same quote; they are counted before they move.
    """
    counts = evidence.groupBy(F.col("quote").alias("c_quote")).agg(F.count("*").alias("n_quotes"))
    e = evidence.select(F.col("evidence_id").alias("e_id"), F.col("document_id").alias("e_doc"), F.col("locator").alias("e_loc"), "quote").join(counts, F.col("quote") == F.col("c_quote"), "left").drop("c_quote")
    b = blocks.select(F.col("document_id").alias("b_doc"), F.col("file_id").alias("b_file"), F.col("locator").alias("b_loc"), "block_type", "text", "cells")
    rows = links.join(e, F.col("evidence_id") == F.col("e_id"), "left").join(b, (F.col("document_id") == F.col("b_doc")) & (F.col("file_id") == F.col("b_file")) & (F.col("locator") == F.col("b_loc")), "left")
    cell = F.get(F.filter("cells", lambda c: (c["row"] == F.col("row")) & (c["column"] == F.col("column"))), F.lit(0))
    table = F.col("cells").isNotNull()
    rows = rows.withColumn("cell", F.when(table, cell)).withColumn("held", F.when(table, F.col("cell.text")).otherwise(F.coalesce("text", F.lit(""))))
    code = (
        F.when(F.col("e_id").isNull(), "EVIDENCE_NOT_FOUND")
        .when(~F.col("document_id").eqNullSafe(F.col("e_doc")) | ~F.col("locator").eqNullSafe(F.col("e_loc")), "PROVENANCE_MISMATCH")
        .when(F.col("b_doc").isNull(), "BLOCK_NOT_FOUND")
        .when(table & F.col("cell").isNull(), "CELL_NOT_FOUND")
        .when(~F.coalesce(F.col("held").contains(F.col("quote")), F.lit(False)), "QUOTE_NOT_FOUND")
        .otherwise("OK")
    )
    at = F.position("quote", "text")
    first = F.greatest(F.lit(1), at - AROUND)
    excerpt = F.when(~table & (at > 0), F.substring("text", first, at - first + F.length("quote") + AROUND))
    flags = F.array_compact(
        F.array(
            F.when(F.col("quote").rlike(r"^[\s0-9,.$%+\-:/()]+$"), "NUMERIC_OR_SYMBOL_ONLY_QUOTE"),
            F.when(F.length("quote") <= 8, "SHORT_QUOTE_LE_8"),
            F.when(F.col("n_quotes") > 1, "DUPLICATE_QUOTE_TEXT"),
        )
    )
    shown = F.when(table, F.lit("TABLE")).otherwise(F.coalesce("block_type", F.lit("TEXT")))
    return rows.select("question_id", "slot_name", "evidence_id", code.alias("code"), F.when(F.col("b_doc").isNotNull(), shown).alias("block_type"), F.when(table, F.col("row")).alias("row"), F.when(table, F.col("column")).alias("column"), F.col("cell.text").alias("cell_text"), excerpt.alias("excerpt"), "n_quotes", flags.alias("flags"))


def field_matches(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(source_id, target_id, matches, score, n_compared, n_matches, n_contradictions) of pairs (source_id, target_id).

    facts: (document_id, metric_code, value_status, value). matches: metric to whether the facts agree, null where a side has
    no disclosed value, which is no contradiction. Amounts agree as numbers, other values as texts without regard to case,
    width, white space, punctuation and symbols. score: the sum of the weights of the metrics that agree.
    """
    metrics = list(IDENTITY_WEIGHTS)
    known = facts.filter((F.col("value_status") == "DISCLOSED") & F.col("value").isNotNull())
    amount = F.col("metric_code") == "CONTRACT_AMOUNT"
    # what agrees is equal in this form; a number that cannot be read agrees with nothing, but can be compared
    number = F.regexp_replace("value", ",", "").try_cast("double")
    form = F.when(amount, F.coalesce(number.cast("string"), F.concat(F.lit("?"), "document_id"))).otherwise(normal_text(F.col("value")))
    wide = known.select("document_id", "metric_code", form.alias("form")).groupBy("document_id").pivot("metric_code", metrics).agg(F.first("form"))
    side = lambda name: wide.select(F.col("document_id").alias(f"{name}_doc"), F.struct(*metrics).alias(name))
    rows = pairs.join(side("s"), F.col("source_id") == F.col("s_doc"), "left").join(side("t"), F.col("target_id") == F.col("t_doc"), "left")
    agree = {m: F.col(f"s.{m}") == F.col(f"t.{m}") for m in metrics}
    count = lambda ok: sum((F.coalesce(ok(x), F.lit(False)).cast("int") for x in agree.values()), F.lit(0))
    score = sum((F.when(ok, IDENTITY_WEIGHTS[m]).otherwise(0.0) for m, ok in agree.items()), F.lit(0.0))
    matches = F.create_map(*(x for m, ok in agree.items() for x in (F.lit(m), ok)))
    return rows.select("source_id", "target_id", matches.alias("matches"), F.round(score, 4).alias("score"), count(lambda x: x.isNotNull()).alias("n_compared"), count(lambda x: x).alias("n_matches"), count(lambda x: ~x).alias("n_contradictions"))


def termination_packets(candidates: DataFrame, documents: DataFrame, evidence: DataFrame, amends: DataFrame) -> DataFrame:
    """(source_id, target_id, score, evidence, requires_amends, amends_id, machine_status, review_status, problem) of candidates
    (source_id, target_id, score, status) with status HIGH_CONFIDENCE_REVIEW.

    evidence: ids of the source's first MOST_EVIDENCE quotes that name a termination. A target that is a correction blocks
    the packet until its own chain is closed. problem: MISSING_DOCUMENT or NO_EXPLICIT_EVIDENCE; such packets must not go out.
    """
    named = top_per(evidence.filter(F.col("quote").contains(TERMINATION)), ["document_id"], ["evidence_id"], MOST_EVIDENCE)
    named = named.groupBy(F.col("document_id").alias("n_doc")).agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence"))
    known = documents.select(F.col("document_id").alias("d_id"), "is_correction")
    first = amends.groupBy(F.col("source_id").alias("a_id")).agg(F.min("relation_id").alias("amends_id"))
    rows = candidates.filter(F.col("status") == "HIGH_CONFIDENCE_REVIEW")
    rows = rows.join(known.select(F.col("d_id").alias("s_doc")), F.col("source_id") == F.col("s_doc"), "left").join(known, F.col("target_id") == F.col("d_id"), "left").join(named, F.col("source_id") == F.col("n_doc"), "left").join(first, F.col("target_id") == F.col("a_id"), "left")
    needs = F.coalesce("is_correction", F.lit(False))
    problem = F.when(F.col("s_doc").isNull() | F.col("d_id").isNull(), "MISSING_DOCUMENT").when(F.col("evidence").isNull(), "NO_EXPLICIT_EVIDENCE")
    status = F.when(needs, "BLOCKED_UNTIL_TARGET_AMENDS_CHAIN_CLOSURE").otherwise("READY_FOR_HUMAN_REVIEW")
    return rows.select("source_id", "target_id", "score", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), needs.alias("requires_amends"), F.when(needs, F.col("amends_id")).alias("amends_id"), status.alias("machine_status"), F.lit("PENDING").alias("review_status"), problem.alias("problem"))


def parse_blocked(queue: DataFrame, coverage: DataFrame) -> DataFrame:
    """``queue`` (question_id, anchors, tags, dependencies and more) with blocked: its anchors whose parse failed, in their order.

    Blocked questions get the status PARSE_BLOCKED, the tag parse_blocked and the dependency PDF_PARSER_OR_MANUAL_PDF_REVIEW.
    """
    failed = coverage.filter(F.col("state") == "PARSE_FAILED").select("document_id").distinct()
    hits = queue.select("question_id", F.posexplode("anchors").alias("at", "document_id")).join(failed, "document_id", "left_semi")
    hits = hits.groupBy(F.col("question_id").alias("h_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "document_id"))), lambda x: x["document_id"]).alias("blocked"))
    is_blocked = F.col("blocked").isNotNull()
    more = lambda c, x: F.when(is_blocked, F.array_distinct(F.concat(c, F.array(F.lit(x))))).otherwise(F.col(c))
    rows = queue.join(hits, F.col("question_id") == F.col("h_id"), "left").drop("h_id")
    return rows.withColumns({"tags": more("tags", "parse_blocked"), "dependencies": more("dependencies", "PDF_PARSER_OR_MANUAL_PDF_REVIEW"), "status": F.when(is_blocked, "PARSE_BLOCKED").otherwise("OPEN"), "blocked": F.coalesce("blocked", F.array().cast("array<string>"))})


def second_reviews(first: DataFrame, second: DataFrame) -> DataFrame:
    """(review_id, first, second, code) of every review of either side; code: AGREED, DISAGREED, NO_FIRST_REVIEW, NO_SECOND_REVIEW."""
    rows = first.select("review_id", F.col("decision").alias("first")).join(second.select("review_id", F.col("decision").alias("second")), "review_id", "full_outer")
    code = F.when(F.col("first").isNull(), "NO_FIRST_REVIEW").when(F.col("second").isNull(), "NO_SECOND_REVIEW").when(F.col("first") == F.col("second"), "AGREED").otherwise("DISAGREED")
    return rows.select("review_id", "first", "second", code.alias("code"))
