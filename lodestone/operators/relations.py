"""Relations between documents: candidates, references, identity scores, review statuses and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.components import components
from lodestone.operators.ranking import earlier, top_per


def amends_candidates(documents: DataFrame, source: Column, same: list[str], fields: list[str], score: Column, n: int = 5) -> DataFrame:
    """Earlier documents that a correction may amend, best first.

    documents has doc_id, day, ``same`` and ``fields``; ``source`` tells the corrections; ``score`` is over s_* (source) and
    d_* (candidate) columns, and must not fall when more ``fields`` are equal or the candidate is later. Candidates share
    ``same``, are strictly earlier and score above 0; ties go to the later document.
    """
    own = [c for c in documents.columns if c not in same]
    rows = earlier(documents.withColumn("_source", source), same, fields, ["day", "doc_id"], n, own, F.col("_source")).filter("_source")
    pairs = rows.select(*(F.col(c).alias(f"s_{c}") for c in documents.columns), F.explode("earlier").alias("d"))
    pairs = pairs.select("*", *(F.col(f"d.{c}" if c in own else f"s_{c}").alias(f"d_{c}") for c in documents.columns)).drop("d")
    pairs = pairs.withColumn("score", F.least(F.lit(1.0), score)).filter("score > 0")
    return top_per(pairs, ["s_doc_id"], [F.col("score").desc(), F.col("d_day").desc(), F.col("d_doc_id").desc()], n)


def amends_score() -> Column:
    """Same subtype 0.25, same report name 0.25, same period 0.45, and 0.2 within 30 days or 0.1 within a year."""
    days = F.datediff("s_day", "d_day")
    part = lambda ok, x: F.when(ok, x).otherwise(0.0)
    return (
        part((F.col("s_subtype") == F.col("d_subtype")) & (F.col("s_subtype") != ""), 0.25)
        + part(F.col("s_name") == F.col("d_name"), 0.25)
        + part(F.col("s_period").isNotNull() & (F.col("s_period") == F.col("d_period")), 0.45)
        + F.when(days <= 30, 0.2).when(days <= 365, 0.1).otherwise(0.0)
    )


def references(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, status, targets) for each source (doc_id, corp, ref_day, ref_family) over documents (doc_id, corp, day, family).

    Targets share company and day. If the family of one contains the other's for some, only those count. Statuses:
    REFERENCE_NOT_PARSED (no day), TARGET_NOT_IN_CORPUS, MATCHED_IN_CORPUS (one), AMBIGUOUS.
    """
    s = sources.select(F.col("doc_id").alias("s_id"), F.col("corp").alias("s_corp"), "ref_day", F.coalesce("ref_family", F.lit("")).alias("ref_family"))
    d = documents.select(F.col("doc_id").alias("d_id"), F.col("corp").alias("d_corp"), "day", F.coalesce("family", F.lit("")).alias("family"))
    rows = s.join(d, (F.col("s_corp") == F.col("d_corp")) & (F.col("ref_day") == F.col("day")) & (F.col("s_id") != F.col("d_id")), "left")
    kin = F.col("d_id").isNotNull() & (F.col("family").contains(F.col("ref_family")) | F.col("ref_family").contains(F.col("family")))
    found = rows.groupBy("s_id", "ref_day").agg(F.array_sort(F.collect_set(F.when(kin, F.col("d_id")))).alias("kin"), F.array_sort(F.collect_set("d_id")).alias("every"))
    targets = F.when(F.size("kin") > 0, F.col("kin")).otherwise(F.col("every"))
    status = F.when(F.col("ref_day").isNull(), "REFERENCE_NOT_PARSED").when(F.size(targets) == 0, "TARGET_NOT_IN_CORPUS").when(F.size(targets) == 1, "MATCHED_IN_CORPUS").otherwise("AMBIGUOUS")
    return found.select(F.col("s_id").alias("doc_id"), status.alias("status"), targets.alias("targets"))


def merged_candidates(explicit: Column, candidates: Column) -> Column:
    """The explicit target before the other candidates, which lose its copy."""
    return F.when(explicit.isNull(), candidates).otherwise(F.concat(F.array(explicit), F.filter(candidates, lambda c: c != explicit)))


def identity_score(weights: dict[str, float], equal: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(score, matches, contradictions); ``equal`` holds for each field true, false, or null if it cannot be compared."""
    score, matches, against = F.lit(0.0), F.lit(0), F.lit(0)
    for field, same in equal.items():
        score = score + F.when(same, weights[field]).otherwise(0.0)
        matches = matches + F.when(same, 1).otherwise(0)
        against = against + F.when(~same, 1).otherwise(0)
    return F.round(score, 4), matches, against


def decided(rows: DataFrame, source: str, order: list, least: float = 0.7, matches: int = 2, contradictions: int = 1, gap: float = 0.2) -> DataFrame:
    """The first candidate of each source with its status: high confidence only if it leads the second by ``gap``."""
    w = Window.partitionBy(source).orderBy(*order)
    ranked = rows.withColumn("second", F.lead("score").over(w)).withColumn("rank", F.row_number().over(w)).filter("rank = 1")
    sure = (F.col("score") >= least) & (F.col("matches") >= matches) & (F.col("contradictions") <= contradictions) & (F.col("second").isNull() | (F.round(F.col("score") - F.col("second"), 4) >= gap))
    return ranked.withColumn("status", F.when(sure, "HIGH_CONFIDENCE_REVIEW").otherwise("MANUAL_DISAMBIGUATION_REQUIRED")).drop("rank")


def amends_status(coverage: Column, reference: Column, n_candidates: Column) -> Column:
    return (
        F.when(~coverage.eqNullSafe("PRESENT"), "PARSE_BLOCKED")
        .when(reference == "MATCHED_IN_CORPUS", "READY_FOR_HUMAN_REVIEW")
        .when(reference == "TARGET_NOT_IN_CORPUS", "TARGET_OUTSIDE_CORPUS_REVIEW")
        .when(reference == "AMBIGUOUS", "AMBIGUOUS_REVIEW")
        .when(n_candidates > 0, "AMBIGUOUS_REVIEW")
        .otherwise("NO_TARGET_CANDIDATE_REVIEW")
    )


def terminates_status(coverage: Column, identity: Column, target_open: Column) -> Column:
    """target_open: whether the target is itself a correction with a relation that is still reviewed."""
    return (
        F.when(~coverage.eqNullSafe("PRESENT"), "PARSE_BLOCKED")
        .when((identity == "HIGH_CONFIDENCE_REVIEW") & target_open, "BLOCKED_UNTIL_TARGET_AMENDS_REVIEW")
        .when(identity == "HIGH_CONFIDENCE_REVIEW", "READY_FOR_HUMAN_REVIEW")
        .when(identity == "NO_TARGET_IN_MANIFEST_CANDIDATES", "NO_TARGET_CANDIDATE_REVIEW")
        .otherwise("AMBIGUOUS_REVIEW")
    )


def chains(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, chain_id) of every document: the smallest document that relations (a, b) connect it with."""
    labels = components(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    return documents.select("doc_id").join(labels, F.col("doc_id") == F.col("v"), "left").select("doc_id", F.coalesce("label", "doc_id").alias("chain_id"))


def most_exposed(chained: DataFrame, split: str, exposure: tuple[str, ...] = ("DEV_TUNE", "DEV_CHECK", "HOLDOUT")) -> DataFrame:
    """(chain_id, split): a whole chain goes to the most exposed split that one of its documents is in."""
    rank = F.array_position(F.array(*(F.lit(s) for s in exposure)), F.col(split))
    return chained.groupBy("chain_id").agg(F.min_by(F.col(split), F.when(rank > 0, rank)).alias("split"))


#: Statuses that need a target, and those that must not have one. Fixed values.
WITH_TARGET = ("READY_FOR_HUMAN_REVIEW", "BLOCKED_UNTIL_TARGET_AMENDS_REVIEW")
PENDING = "PENDING_HUMAN_REVIEW"


def basis(kind: Column, coverage: Column, reference: Column, identity: Column, n_candidates: Column, blocked: Column) -> Column:
    """Why a recommendation has its status: an array of codes."""
    of = lambda *codes: F.array(*(F.lit(c) for c in codes))
    amends = F.when(reference == "MATCHED_IN_CORPUS", of("EXPLICIT_REFERENCE_UNIQUE_MATCH")).when(reference == "TARGET_NOT_IN_CORPUS", of("EXPLICIT_REFERENCE_TARGET_OUTSIDE_CORPUS")).when(reference == "AMBIGUOUS", of("EXPLICIT_REFERENCE_AMBIGUOUS"))
    amends = amends.when(n_candidates > 0, of("MANIFEST_CANDIDATES_ONLY")).otherwise(of("NO_PRIOR_MANIFEST_CANDIDATE"))
    word = "EXPLICIT_TERMINATION_WORDING"
    ends = F.when(identity == "HIGH_CONFIDENCE_REVIEW", F.when(blocked, of("FACT_IDENTITY_HIGH_CONFIDENCE", word, "TARGET_AMENDS_REVIEW_PENDING")).otherwise(of("FACT_IDENTITY_HIGH_CONFIDENCE", word)))
    ends = ends.when(identity == "NO_TARGET_IN_MANIFEST_CANDIDATES", of("NO_PRIOR_MANIFEST_CANDIDATE", word)).otherwise(of("FACT_IDENTITY_AMBIGUOUS", word))
    return F.when(~coverage.eqNullSafe("PRESENT"), of("PARSE_NOT_FULLY_USABLE")).when(kind == "AMENDS", amends).otherwise(ends)


def recommendations(candidates: DataFrame, documents: DataFrame, coverage: DataFrame, refs: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One row for each relation candidate with its source, coverage, target, status, basis and evidence; always pending.

    candidates: (relation_id, relation_type, source_id, identity_status, candidates: array of ids, best first). Sources must
    have a document and a coverage row, or the query fails. A matched reference goes before the candidates. Only what is ready
    or waits for its target has a target. evidence: (document_id, evidence_id) of the sources' bundles, reduced to one row a
    document before it is joined.
    """
    d = documents.select(F.col("doc_id").alias("d_id"), F.col("report_name").alias("source_name"), F.col("is_correction").alias("d_correction"))
    c = coverage.select(F.col("document_id").alias("c_id"), "coverage_state", "reason")
    r = refs.select(F.col("doc_id").alias("r_id"), F.col("status").alias("reference"), F.when(F.col("status") == "MATCHED_IN_CORPUS", F.try_element_at("targets", F.lit(1))).alias("explicit"))
    amended = candidates.filter("relation_type = 'AMENDS'").select(F.col("source_id").alias("a_id")).distinct()
    rows = candidates.join(d, F.col("source_id") == F.col("d_id"), "left").join(c, F.col("source_id") == F.col("c_id"), "left").join(r, F.col("source_id") == F.col("r_id"), "left")
    rows = rows.withColumn("checked", F.when(F.col("d_id").isNull() | F.col("c_id").isNull(), F.raise_error(F.concat(F.col("source_id").cast("string"), F.lit(": source document or coverage missing")))).otherwise(F.lit(True))).filter("checked")
    rows = rows.withColumn("candidates", F.when(F.col("relation_type") == "AMENDS", merged_candidates(F.col("explicit"), F.col("candidates"))).otherwise(F.col("candidates"))).withColumn("first_id", F.try_element_at("candidates", F.lit(1)))
    t = documents.select(F.col("doc_id").alias("t_id"), F.col("report_name").alias("t_name"), F.col("is_correction").alias("t_correction"))
    rows = rows.join(t, F.col("first_id") == F.col("t_id"), "left").join(amended, F.col("first_id") == F.col("a_id"), "left")
    blocked, n, kind = F.coalesce(F.col("t_correction") & F.col("a_id").isNotNull(), F.lit(False)), F.size("candidates"), F.col("relation_type")
    status = F.when(kind == "AMENDS", amends_status(F.col("coverage_state"), F.col("reference"), n)).otherwise(terminates_status(F.col("coverage_state"), F.col("identity_status"), blocked))
    if evidence is None:
        rows = rows.withColumn("evidence", F.array().cast("array<string>"))
    else:
        held = evidence.groupBy(F.col("document_id").alias("e_id")).agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence"))
        rows = rows.join(held, F.col("source_id") == F.col("e_id"), "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    has = status.isin(*WITH_TARGET)
    return rows.select(
        "relation_id", "relation_type", "source_id", "source_name", "coverage_state", "reason", F.when(has, F.col("first_id")).alias("target_id"), F.when(has, F.col("t_name")).alias("target_name"), n.alias("n_candidates"), "candidates",
        F.slice("candidates", 1, 5).alias("first_candidates"), "evidence", status.alias("machine_status"), basis(kind, F.col("coverage_state"), F.col("reference"), F.col("identity_status"), n, blocked).alias("basis"), F.lit(PENDING).alias("review_status"),
    )


def termination_evidence(rows: DataFrame, most: int = 10) -> DataFrame:
    """(document_id, quotes): the first rows of a document that name a termination, in its order."""
    hits = rows.filter(F.col("text").contains("해지"))
    ranked = top_per(hits, ["document_id"], ["position"], most)
    return ranked.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("q")).select("document_id", F.transform("q", lambda x: x["text"]).alias("quotes"))
