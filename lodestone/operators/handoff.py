"""Checks of what one team hands to another: a queue of questions, bundles of facts with evidence, chunks for known questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.constraints import unique
from lodestone.operators.coverage import all_of, violations
from lodestone.operators.evaluation import leakage
from lodestone.sources.shared import dealt

#: What an anchored question waits for. Fixed values.
CLOSURE, PROVISIONAL = "RELATION_CHAIN_CLOSURE", "PROVISIONAL_UNTIL_CHAIN_CLOSURE"


def _told(df: DataFrame, rule: str, key: str, message: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(message).alias("message"))


def queue(rows: DataFrame, documents: DataFrame, coverage: DataFrame) -> DataFrame:
    """(rule, key, message) of what is wrong with a queue of questions to be written.

    rows: (assignment_id, evaluation_group_id, question_draft, gold_status, planned_split, split_lock_status, authoring_status,
    anchors, known_chain_ids, dependencies, tags, blocked: arrays); documents: (document_id); coverage: (document_id, state).
    Groups, anchors and chains must not stand in several splits. Anchors and chains are looked up one by one, each row once;
    what an anchor decides is judged where the anchors of a row meet again, so that whole rows need not move.
    """
    anchored, chained, lock = F.size("anchors") > 0, F.size("known_chain_ids") > 0, F.col("split_lock_status")
    failed = coverage.filter(F.col("state") == "PARSE_FAILED").select("document_id").distinct()
    # rows are known by their content, since ids may repeat; copies of a row are counted
    own = F.unhex(F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    held = rows.select(own.alias("_row"), "assignment_id", "authoring_status", F.array_contains("tags", "parse_blocked").alias("tagged"), "blocked", F.posexplode("anchors").alias("at", "document_id"))
    (hits,) = dealt((held.join(failed, "document_id", "left_semi"), ["_row"]), rows=rows.count())
    hits = hits.groupBy("_row", "assignment_id", "authoring_status", "tagged", "blocked").agg(F.array_sort(F.collect_set(F.struct("at", "document_id"))).alias("b_now"), F.count("*").alias("n"))
    hits = hits.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("n") / F.size("b_now")).cast("int"))))
    now = F.transform("b_now", lambda x: x["document_id"])
    blocked = {
        "BLOCKED_STATUS": (~F.col("authoring_status").eqNullSafe("PARSE_BLOCKED"), "an anchor's parse failed, so it is blocked"),
        "BLOCKED_TAG": (~F.coalesce("tagged", F.lit(False)), "a blocked question has the tag"),
        "BLOCKED_ANCHORS": (~F.col("blocked").eqNullSafe(now), "the blocked anchors are not those of now"),
    }
    rules = {
        "QUESTION": (F.col("question_draft").isNull() | (F.col("question_draft") == "") | F.col("evaluation_group_id").isNull(), "a question and its group are needed"),
        "GOLD_STATUS": (~F.col("gold_status").eqNullSafe("NOT_STARTED"), "a queued question is not gold"),
        "ANCHORED_IS_PROVISIONAL": (anchored & ~chained & (lock != PROVISIONAL), "an anchored split stays provisional until its chain is closed"),
        "ANCHORED_WAITS": (anchored & ~F.coalesce(F.array_contains("dependencies", CLOSURE), F.lit(False)), "an anchored question waits for its chain"),
        "ANCHORLESS_LOCK": (~anchored & (lock != "LOCKED_BY_COVERAGE"), "a question without anchors is locked by coverage"),
        "CHAIN_LOCK": (chained & (lock != "LOCKED_BY_CHAIN"), "a question with chains is locked by them"),
    }
    at = rows.select("assignment_id", F.explode("anchors").alias("document_id"))
    unknown = at.join(documents.select("document_id").distinct(), "document_id", "left_anti")
    leaks = leakage(rows, "planned_split", {"GROUP": "evaluation_group_id"})
    for kind, column in (("ANCHOR", "anchors"), ("CHAIN", "known_chain_ids")):
        leaks = leaks.unionByName(leakage(rows.select("planned_split", F.explode(column).alias("of")), "planned_split", {kind: "of"}))
    return all_of(
        violations(rows, "assignment_id", rules),
        violations(hits, "assignment_id", blocked),
        unique(rows, "assignment_id"),
        _told(unknown, "ANCHOR_UNKNOWN", "assignment_id", "an anchor is not in the corpus"),
        leaks.select(F.concat(F.col("kind"), F.lit("_LEAKS")).alias("rule"), "key", F.array_join("splits", ",").alias("message")),
    )


def bundles(rows: DataFrame, snapshot: str, counts: dict[str, int]) -> DataFrame:
    """(rule, key, message) of what is wrong with bundles of facts that are handed over as candidates.

    rows: (document_id, corpus_snapshot_id, facts: array of (fact_id, verification_status, evidence_ids), evidence: array of
    (evidence_id, verification_status)); counts: what the manifest says of bundle_count, fact_count and evidence_count.
    """
    found = {"bundle_count": F.count("*"), "fact_count": F.coalesce(F.sum(F.size("facts")), F.lit(0)), "evidence_count": F.coalesce(F.sum(F.size("evidence")), F.lit(0))}
    total = rows.agg(*(x.cast("long").alias(n) for n, x in found.items()))
    differ = F.array_compact(F.array(*(F.when(F.col(n) != counts[n], F.struct(F.lit(n).alias("key"), F.concat(F.lit(f"manifest={counts[n]} actual="), F.col(n).cast("string")).alias("message"))) for n in counts)))
    facts = rows.select("document_id", F.explode("facts").alias("f"), F.transform("evidence", lambda e: e["evidence_id"]).alias("known")).select("f.*", "known")
    pieces = rows.select(F.explode("evidence").alias("e")).select("e.*")
    missing = facts.select("fact_id", F.explode(F.array_except("evidence_ids", "known")).alias("evidence_id"))
    return all_of(
        violations(rows, "document_id", {"SNAPSHOT": (~F.col("corpus_snapshot_id").eqNullSafe(snapshot), "the bundle is of another snapshot")}),
        unique(rows, "document_id"),
        violations(facts, "fact_id", {"FACT_IS_CANDIDATE": (~F.col("verification_status").eqNullSafe("CANDIDATE"), "a fact that is handed over is a candidate")}),
        violations(pieces, "evidence_id", {"EVIDENCE_IS_CANDIDATE": (~F.col("verification_status").eqNullSafe("CANDIDATE"), "evidence that is handed over is a candidate")}),
        missing.select(F.lit("EVIDENCE_EXISTS").alias("rule"), F.col("fact_id").alias("key"), F.concat(F.lit("no evidence "), "evidence_id").alias("message")),
        total.select(F.explode(differ).alias("d")).select(F.lit("COUNT").alias("rule"), "d.key", "d.message"),
    )


def evidence_coverage(chunks: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, n_required, n_found) of questions with known evidence: how many of their spans a chunk that may be found has.

    chunks: (document_id, retrieval_eligible, source_spans with node_id); seeds: (query_id, document_id, node_id), one row a
    required span. Spans of chunks are made distinct before they move.
    """
    there = chunks.filter("retrieval_eligible").select("document_id", F.explode(F.transform("source_spans", lambda s: s["node_id"])).alias("node_id")).distinct().withColumn("hit", F.lit(True))
    rows = seeds.distinct().join(there, ["document_id", "node_id"], "left")
    return rows.groupBy("query_id").agg(F.count("*").alias("n_required"), F.count_if(F.col("hit")).alias("n_found"))
