"""Scoring of recorded answers against gold, summaries, leakage and drift, and evidence checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numeric_match(comparator: Column, expected: Column, actual: Column, tolerance: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """PASS or FAIL by the comparator; NOT_SCORED without an expected value or a stated number.

    RANGE is inclusive and needs both ends. RELATIVE allows |expected| times the tolerance, all others the tolerance; a
    tolerance that is not set is 0.
    """
    off, slack = F.abs(actual - expected), F.coalesce(tolerance, F.lit(0.0))
    low, high = expected if low is None else low, expected if high is None else high
    ranged = comparator.eqNullSafe("RANGE")
    ok = F.when(ranged, actual.between(low, high)).otherwise(off <= F.when(comparator == "RELATIVE", F.abs(expected) * slack).otherwise(slack))
    unscored = F.when(ranged, low.isNull() | high.isNull()).otherwise(expected.isNull()) | comparator.isNull() | actual.isNull() | F.isnan(actual)
    return F.when(unscored, "NOT_SCORED").when(ok, "PASS").otherwise("FAIL")


def boolean_match(expected: Column, stated: Column) -> Column:
    """Whether a stated truth value is the expected one; NOT_SCORED if none is stated."""
    return F.when(expected.isNull() | stated.isNull(), "NOT_SCORED").when(expected == stated, "PASS").otherwise("FAIL")


def text_match(expected: Column, stated: Column, answer: Column) -> Column:
    """A stated text must equal the expected one; without it, the answer must contain it; NOT_SCORED without either."""
    ok = F.when(stated.isNotNull(), stated == expected).otherwise(answer.contains(expected))
    return F.when(expected.isNull() | ok.isNull(), "NOT_SCORED").when(ok, "PASS").otherwise("FAIL")


def structured_number(result: Column, value: Column) -> Column:
    """The number that an answer states: ``result``, else ``value``; texts count if they are a number, prose never does."""
    read = lambda c: F.when(c.cast("string").rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(c.cast("string")).try_cast("double"))
    return F.when(result.isNotNull(), read(result)).otherwise(read(value))


def object_status(statuses: Column) -> Column:
    """An object's status from its fields': NOT_SCORED if none is scored, FAIL if any fails or is not scored, else PASS."""
    return F.when(~F.exists(statuses, lambda s: s != "NOT_SCORED"), "NOT_SCORED").when(F.exists(statuses, lambda s: s.isin("FAIL", "NOT_SCORED")), "FAIL").otherwise("PASS")


def policy_status(required: Column, forbidden: Column, operations: Column) -> Column:
    """Whether all required operations ran and no forbidden one."""
    return F.when((F.size(F.array_except(required, operations)) == 0) & ~F.arrays_overlap(forbidden, operations), "PASS").otherwise("FAIL")


def usable(http_status: Column, valid: Column, asked: Column, echoed: Column) -> Column:
    return http_status.between(200, 299) & valid & asked.eqNullSafe(echoed)


def tally(metrics: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Counts of each status."""
    names = ("PASS", "FAIL", "NOT_SCORED", "REVIEW_REQUIRED")
    return metrics.groupBy(*by).agg(*(F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in names))


def summary(runs: DataFrame, ok: str, error: str, latency: str) -> DataFrame:
    """One row: runs, successes, error classes, and nearest-rank 50 and 95 percent latencies."""
    runs = runs.withColumn("_ms", F.when(~F.isnan(latency) & (F.abs(latency) != float("inf")), F.col(latency)))
    return runs.agg(
        F.count("*").alias("n_runs"),
        F.count_if(F.col(ok)).alias("n_ok"),
        F.count_distinct(error).alias("n_error_classes"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _ms)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY _ms)").alias("p95"),
    )


def leakage(rows: DataFrame, split: str, keys: dict[str, str]) -> DataFrame:
    """(kind, key, splits): groups, documents or chains (``keys``: kind to column) that stand in more than one split."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in keys.items())))
    found = rows.select(F.col(split).alias("split"), pairs.alias("p")).filter("p.key is not null").groupBy(F.col("p.kind").alias("kind"), F.col("p.key").alias("key"))
    return found.agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def drift(runs: DataFrame, group: str, order: list[str], frozen: list[str]) -> DataFrame:
    """Runs whose frozen fields differ from those of the first run of their group, with the names of the fields."""
    first = Window.partitionBy(group).orderBy(*order)
    names = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.first(c).over(first)), F.lit(c)) for c in frozen)))
    return runs.withColumn("drifted", names).filter(F.size("drifted") > 0)


def unique_first(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def groundedness(slots: DataFrame, contexts: DataFrame, verified: DataFrame) -> DataFrame:
    """(question_id, slot_id, grounded) of every slot: whether one of its question's contexts proves it.

    slots: (question_id, slot_id, sources: array of (document_id, locator, quote)); a slot without sources is never
    grounded. A context (question_id, evidence_id, document_id, locator, quote) that names evidence proves the slot if
    ``verified`` (question_id, slot_id, evidence_id, document_id, locator, quote_sha256) has that evidence for it and
    nothing that the context says contradicts it. A context that names none proves it by an acceptable source of the same
    document, locator and quote. The two ways never mix.
    """
    named = (F.col("evidence_id") != "") & F.col("evidence_id").isNotNull()
    v = verified.select(F.col("question_id").alias("v_q"), "slot_id", F.col("evidence_id").alias("v_e"), F.col("document_id").alias("v_doc"), F.col("locator").alias("v_loc"), "quote_sha256")
    agrees = F.coalesce(F.col("document_id") == F.col("v_doc"), F.col("document_id").isNull()) & F.coalesce(F.col("locator") == F.col("v_loc"), F.lit(True)) & F.coalesce(F.sha2("quote", 256) == F.col("quote_sha256"), F.lit(True))
    by_id = contexts.filter(named).join(v, (F.col("question_id") == F.col("v_q")) & (F.col("evidence_id") == F.col("v_e"))).filter(agrees).select("question_id", "slot_id")
    sources = slots.select(F.col("question_id").alias("s_q"), "slot_id", F.explode("sources").alias("s"))
    same = (F.col("question_id") == F.col("s_q")) & (F.col("quote") == F.col("s.quote")) & F.col("document_id").eqNullSafe(F.col("s.document_id")) & F.col("locator").eqNullSafe(F.col("s.locator"))
    by_place = contexts.filter(~named | F.col("evidence_id").isNull()).join(sources, same).select("question_id", "slot_id")
    proven = by_id.unionByName(by_place).distinct().withColumnsRenamed({"question_id": "p_q", "slot_id": "p_s"}).withColumn("hit", F.lit(True))
    rows = slots.join(proven, (F.col("question_id") == F.col("p_q")) & (F.col("slot_id") == F.col("p_s")), "left")
    return rows.select("question_id", "slot_id", (F.coalesce("hit", F.lit(False)) & (F.coalesce(F.size("sources"), F.lit(0)) > 0)).alias("grounded"))


_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _all_in(answer: Column, wanted: Column) -> Column:
    """PASS if the answer contains all wanted texts, NOT_SCORED if none is wanted."""
    return F.when(F.size(wanted) == 0, "NOT_SCORED").when(F.forall(wanted, lambda x: F.coalesce(answer, F.lit("")).contains(x)), "PASS").otherwise("FAIL")


def open_scores(gold: DataFrame, responses: DataFrame, grounded: DataFrame) -> DataFrame:
    """(question_id and one status for each measure) of every response to an open question.

    gold: (question_id, fields: map of the expected answer's texts, documents, evidence_ids); responses: (question_id, answer,
    contexts: array of (document_id, evidence_id)); grounded: as groundedness() gives it. Texts of two characters or more
    must stand in the answer, and so must days, which are a measure of their own. Every context that names a document must
    name one of the question's, and no evidence but the question's. Format is never scored; claims are for reviewers.
    """
    slots = grounded.groupBy(F.col("question_id").alias("g_q")).agg(F.bool_and("grounded").alias("all_grounded"))
    g = gold.withColumnRenamed("question_id", "q_id")
    rows = responses.join(g, F.col("question_id") == F.col("q_id")).join(slots, F.col("question_id") == F.col("g_q"), "left")
    texts = F.coalesce(F.filter(F.map_values("fields"), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    cited = F.coalesce(F.filter("contexts", lambda c: c["document_id"].isNotNull()), F.array().cast(responses.schema["contexts"].dataType))
    known = F.forall(cited, lambda c: F.coalesce(F.array_contains("documents", c["document_id"]), F.lit(False)) & (c["evidence_id"].isNull() | F.coalesce(F.array_contains("evidence_ids", c["evidence_id"]), F.lit(False))))
    return rows.select(
        "question_id",
        F.when(F.col("all_grounded").isNull(), "NOT_SCORED").when(F.col("all_grounded"), "PASS").otherwise("FAIL").alias("required_evidence_coverage"),
        _all_in(F.col("answer"), F.filter(texts, lambda x: (F.length(x) >= 2) & ~x.rlike(_DAY))).alias("explicit_fact_value_slots"),
        _all_in(F.col("answer"), F.filter(texts, lambda x: x.rlike(_DAY))).alias("temporal_requirements"),
        F.lit("NOT_SCORED").alias("requested_format"),
        F.lit("REVIEW_REQUIRED").alias("claim_coverage"),
        F.when(F.size(cited) == 0, "NOT_SCORED").when(known, "PASS").otherwise("FAIL").alias("groundedness"),
    )


def citation_codes(citations: DataFrame, evidence: DataFrame | None, blocks: DataFrame | None, snapshot: str | None = None) -> DataFrame:
    """(evidence_id, code) of each citation: the first check that fails, or OK.

    Evidence must exist, be of the snapshot, agree in document, file, locator and quote, be verified, and its hash must be the
    quote's; then the document must exist in the snapshot, have the block, and the block hold the quote. No store (None) is
    not the same as no data. citations: (evidence_id, document_id, file_id, locator, quote, quote_sha256); evidence has
    these and verification_status; blocks: (document_id, file_id, locator, text). Evidence and blocks may have
    corpus_snapshot_id, which counts if ``snapshot`` is given.
    """
    if evidence is None:
        return citations.select("evidence_id", F.lit("EVIDENCE_STORE_UNAVAILABLE").alias("code"))
    of = lambda d: F.col("corpus_snapshot_id") if snapshot and "corpus_snapshot_id" in d.columns else F.lit(snapshot)
    fields = ("document_id", "file_id", "locator", "quote", "quote_sha256")
    rows = citations.join(evidence.select(F.col("evidence_id").alias("e_id"), *(F.col(c).alias(f"e_{c}") for c in fields), "verification_status", of(evidence).alias("e_snapshot")), F.col("evidence_id") == F.col("e_id"), "left")
    differ = lambda *names: reduce(or_, (~F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in names))
    digest = F.sha2("quote", 256)
    code = F.when(F.col("e_id").isNull(), "EVIDENCE_NOT_FOUND").when(~F.col("e_snapshot").eqNullSafe(F.lit(snapshot)), "EVIDENCE_SNAPSHOT_MISMATCH").when(differ("document_id", "file_id"), "EVIDENCE_DOCUMENT_MISMATCH")
    code = code.when(differ("locator"), "EVIDENCE_LOCATOR_MISMATCH").when(differ("quote"), "EVIDENCE_QUOTE_MISMATCH").when(~digest.eqNullSafe(F.col("quote_sha256")) | ~digest.eqNullSafe(F.col("e_quote_sha256")), "EVIDENCE_HASH_MISMATCH")
    code = code.when(~F.col("verification_status").eqNullSafe("VERIFIED"), "UNVERIFIED_DATA_FORBIDDEN")
    if blocks is None:
        return rows.select("evidence_id", code.otherwise("DOCUMENT_STORE_UNAVAILABLE").alias("code"))
    documents = blocks.groupBy(F.col("document_id").alias("d_doc")).agg(F.min(of(blocks)).alias("d_snapshot"))
    b = blocks.select(F.col("document_id").alias("b_doc"), F.col("file_id").alias("b_file"), F.col("locator").alias("b_loc"), F.col("text").alias("b_text"))
    rows = rows.join(documents, F.col("document_id") == F.col("d_doc"), "left").join(b, (F.col("document_id") == F.col("b_doc")) & (F.col("file_id") == F.col("b_file")) & (F.col("locator") == F.col("b_loc")), "left")
    code = code.when(F.col("d_doc").isNull(), "DOCUMENT_NOT_FOUND").when(~F.col("d_snapshot").eqNullSafe(F.lit(snapshot)), "SNAPSHOT_MISMATCH").when(F.col("b_doc").isNull(), "LOCATOR_NOT_FOUND")
    code = code.when((F.col("quote") == "") | ~F.coalesce(F.col("b_text").contains(F.col("quote")), F.lit(False)), "QUOTE_MISMATCH").otherwise("OK")
    return rows.select("evidence_id", code.alias("code"))


def eligible(gold: DataFrame, split: str, lifecycle: DataFrame | None = None, allowlist: list[str] | None = None) -> DataFrame:
    """The questions that a run over ``split`` may use.

    An official split has its own questions. The sandbox has those whose assignment (by question_id, else by
    evaluation_group_id, in ``lifecycle``: assignment_id, lock_status) is still provisional; without a lifecycle it has none,
    and an allowlist only narrows it.
    """
    if split != "SANDBOX":
        return gold.filter(F.col("split") == split)
    if lifecycle is None:
        return gold.limit(0)
    own = lifecycle.select(F.col("assignment_id").alias("own_id"), F.col("lock_status").alias("own_lock"))
    group = lifecycle.select(F.col("assignment_id").alias("group_id"), F.col("lock_status").alias("group_lock"))
    rows = gold.join(own, F.col("question_id") == F.col("own_id"), "left").join(group, F.col("evaluation_group_id") == F.col("group_id"), "left")
    rows = rows.filter(F.coalesce("own_lock", "group_lock") == "PROVISIONAL_UNTIL_CHAIN_CLOSURE")
    if allowlist is not None:
        rows = rows.filter(F.col("question_id").isin(allowlist))
    return rows.select(*gold.columns)


def allocation(queue: DataFrame, bucket: str, split: str, targets: DataFrame) -> DataFrame:
    """(bucket, split, n, target, missing) of every target (bucket, split, target) and of every pair in the queue."""
    counts = queue.groupBy(F.col(bucket).alias("bucket"), F.col(split).alias("split")).agg(F.count("*").alias("n"))
    rows = targets.join(counts, ["bucket", "split"], "full_outer")
    n, target = F.coalesce("n", F.lit(0)), F.coalesce("target", F.lit(0))
    return rows.select("bucket", "split", n.alias("n"), target.cast("long").alias("target"), (target - n).cast("long").alias("missing"))


def adopt(baseline: Column, candidate: Column, gain: float = 0.02) -> Column:
    """Whether a chunk strategy may replace the baseline: its recall or gain measure is higher by two points or more."""
    return F.round(candidate - baseline, 9) >= gain


def ndcg(results: DataFrame, relevant: DataFrame, query_key: str, key: str, k: int = 10, digits: int = 6) -> DataFrame:
    """(query, ndcg) at k with relevance 0 or 1."""
    hits = results.filter(F.col("rank") <= k).join(relevant.select(query_key, key).distinct(), [query_key, key], "left_semi").groupBy(query_key).agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    every = relevant.groupBy(query_key).agg(F.least(F.count_distinct(key), F.lit(k)).cast("int").alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return every.join(hits, query_key, "left").select(query_key, F.round(F.coalesce("dcg", F.lit(0.0)) / best, digits).alias("ndcg"))
