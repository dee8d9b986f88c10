"""The relational tables of the data model as Spark schemas, with their keys, and what breaks them.

Fixed values: names, types and keys must equal those of the source format. JSON columns are text; CHECK rules are in
lodestone.operators.constraints.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.constraints import CHECKS, checks, foreign_keys
from lodestone.operators.coverage import all_of, violations


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    refers: tuple[tuple[str, str, str], ...] = ()  # column, table, its key


_SNAPSHOT, _COMPANY, _DOCUMENT = ("corpus_snapshot_id", "corpus_snapshots", "corpus_snapshot_id"), ("corp_code", "companies", "corp_code"), ("document_id", "documents", "document_id")

TABLES = {
    "corpus_snapshots": Table("corpus_snapshot_id string not null, manifest_sha256 string not null, universe_sha256 string not null, document_count int not null, created_at timestamp not null, notes string", ("corpus_snapshot_id",)),
    "companies": Table("corp_code string not null, stock_code string not null, corp_name string not null, listed_name string not null, corp_eng_name string, market string not null, industry string not null, sector_no int, sector string not null, listing_date date, fiscal_month smallint, universe_payload string not null", ("corp_code",), (("stock_code",),)),
    "company_aliases": Table("alias_id string not null, corp_code string not null, alias string not null, normalized_alias string not null, alias_type string not null, valid_from date, valid_to date, source string not null", ("alias_id",), (("corp_code", "normalized_alias", "alias_type"),), (_COMPANY,)),
    "documents": Table("document_id string not null, corpus_snapshot_id string not null, corp_code string not null, doc_group string not null, doc_subtype string, report_name string not null, receipt_number string not null, receipt_date date not null, filer_name string not null, is_correction boolean not null, base_year smallint, base_month smallint, file_path string not null, file_format string not null, declared_file_count int not null, known_at timestamp not null, manifest_payload string not null", ("document_id",), (("corpus_snapshot_id", "receipt_number"),), (_SNAPSHOT, _COMPANY)),
    "files": Table("file_id string not null, document_id string not null, relative_path string not null, file_role string not null, detected_format string not null, detected_encoding string, byte_size bigint, content_sha256 string, is_primary boolean not null", ("file_id",), (("document_id", "relative_path"),), (_DOCUMENT,)),
    "parse_runs": Table("parse_run_id string not null, file_id string not null, parser_name string not null, parser_version string not null, status string not null, started_at timestamp not null, completed_at timestamp, repair_used boolean not null, text_loss_suspected boolean not null, extracted_char_count bigint, warning_count int not null, error_count int not null, diagnostics string not null", ("parse_run_id",), (), (("file_id", "files", "file_id"),)),
    "coverage": Table("coverage_id string not null, corpus_snapshot_id string not null, corp_code string not null, doc_group string not null, period_key string not null, document_id string, state string not null, reason_code string not null, details string not null, assessed_at timestamp not null", ("coverage_id",), (), (_SNAPSHOT, _COMPANY, _DOCUMENT)),
    "sections": Table("section_id string not null, file_id string not null, parent_section_id string, section_path array<string> not null, title string, ordinal int not null, source_locator string not null, char_start bigint, char_end bigint, metadata string not null", ("section_id",), (("file_id", "source_locator"),), (("file_id", "files", "file_id"), ("parent_section_id", "sections", "section_id"))),
    "source_tables": Table("table_id string not null, section_id string not null, title string, source_locator string not null, unit string, scope string not null, period_type string not null, header_rows string not null, body_rows string not null, metadata string not null", ("table_id",), (("section_id", "source_locator"),), (("section_id", "sections", "section_id"),)),
    "chunks": Table("chunk_id string not null, strategy_id string not null, document_id string not null, file_id string not null, section_id string, parent_chunk_id string, chunk_type string not null, ordinal int not null, text_content string not null, token_count int not null, section_path array<string> not null, source_locator string not null, content_fingerprint string not null, duplicate_group_id string, repeated_section boolean not null, metadata string not null", ("chunk_id",), (("strategy_id", "document_id", "ordinal"),), (_DOCUMENT, ("file_id", "files", "file_id"), ("section_id", "sections", "section_id"), ("parent_chunk_id", "chunks", "chunk_id"))),
    "events": Table("event_id string not null, chain_id string not null, corp_code string not null, event_type string not null, event_status string not null, anchor_document_id string not null, event_date date, known_at timestamp not null, valid_from timestamp, valid_to timestamp, verification_status string not null, attributes string not null", ("event_id",), (("chain_id", "event_id"),), (_COMPANY, ("anchor_document_id", "documents", "document_id"))),
    "document_events": Table("document_id string not null, event_id string not null, relation_type string not null, known_at timestamp not null, extraction_method string not null, confidence decimal(5,4)", ("document_id", "event_id", "relation_type"), (), (_DOCUMENT, ("event_id", "events", "event_id"))),
    "evidence": Table("evidence_id string not null, document_id string not null, file_id string not null, chunk_id string, source_locator string not null, quoted_text string, quote_sha256 string, extraction_method string not null, confidence decimal(5,4), verification_status string not null, metadata string not null", ("evidence_id",), (), (_DOCUMENT, ("file_id", "files", "file_id"), ("chunk_id", "chunks", "chunk_id"))),
    "document_relations": Table("relation_id string not null, source_document_id string not null, target_document_id string not null, event_id string, relation_type string not null, known_at timestamp not null, extraction_method string not null, confidence decimal(5,4) not null, evidence_id string, verification_status string not null, attributes string not null", ("relation_id",), (("source_document_id", "target_document_id", "relation_type"),), (("source_document_id", "documents", "document_id"), ("target_document_id", "documents", "document_id"), ("event_id", "events", "event_id"), ("evidence_id", "evidence", "evidence_id"))),
    "document_relation_candidates": Table("relation_candidate_id string not null, source_document_id string not null, relation_type string not null, candidate_targets string not null, review_status string not null, reviewer string, reviewed_at timestamp, review_note string, created_at timestamp not null", ("relation_candidate_id",), (("source_document_id", "relation_type"),), (("source_document_id", "documents", "document_id"),)),
    "facts": Table("fact_id string not null, corp_code string not null, event_id string, source_document_id string not null, metric_code string not null, metric_name string not null, value_type string not null, value_status string not null, value_certainty string not null, raw_value_text string not null, raw_unit_text string, numeric_value decimal(38,9), text_value string, date_value date, boolean_value boolean, unit string, currency string, scale decimal(38,9) not null, scope string not null, period_type string not null, period_start date, period_end date, as_of_date date, known_at timestamp not null, valid_from timestamp, valid_to timestamp, withheld_until date, extraction_method string not null, confidence decimal(5,4), verification_status string not null, attributes string not null", ("fact_id",), (), (_COMPANY, ("event_id", "events", "event_id"), ("source_document_id", "documents", "document_id"))),
    "fact_evidence": Table("fact_id string not null, evidence_id string not null, evidence_role string not null", ("fact_id", "evidence_id"), (), (("fact_id", "facts", "fact_id"), ("evidence_id", "evidence", "evidence_id"))),
    "event_evidence": Table("event_id string not null, evidence_id string not null, evidence_role string not null", ("event_id", "evidence_id"), (), (("event_id", "events", "event_id"), ("evidence_id", "evidence", "evidence_id"))),
    "fact_coverage_snapshots": Table("fact_coverage_snapshot_id string not null, corpus_snapshot_id string not null, semantic_bundle_schema_version string not null, producer_version string not null, created_at timestamp not null, payload_sha256 string not null", ("fact_coverage_snapshot_id",), (), (_SNAPSHOT,)),
    "fact_coverage_snapshot_slots": Table("fact_coverage_snapshot_id string not null, slot_key string not null, corp_code string not null, metric_code string not null, period_key string, scope string, coverage_state string not null, verification_status string not null, fact_ids array<string> not null, evidence_ids array<string> not null, reason_code string", ("fact_coverage_snapshot_id", "slot_key"), (), (("fact_coverage_snapshot_id", "fact_coverage_snapshots", "fact_coverage_snapshot_id"), _COMPANY)),
    "evaluation_questions": Table("question_id string not null, schema_version string not null, evaluation_group_id string not null, split string not null, question string not null, question_type string not null, difficulty string not null, answer_mode string not null, doc_groups array<string> not null, corp_codes array<string> not null, as_of_date date, expected_answerability string not null, expected_answer string not null, authored_against string not null, expected_execution string not null, scoring_spec string not null, tags array<string> not null, created_at timestamp not null", ("question_id",)),
    "evaluation_evidence_slots": Table("slot_id string not null, question_id string not null, slot_name string not null, description string not null, acceptable_sources string not null, expected_fact_ids array<string> not null, expected_event_ids array<string> not null", ("slot_id",), (("question_id", "slot_name"),), (("question_id", "evaluation_questions", "question_id"),)),
    "regression_cases": Table("regression_case_id string not null, question_payload string not null, bug_class string not null, introduced_by_run_id string, fixed_by_commit string, active boolean not null, created_at timestamp not null", ("regression_case_id",)),
    "experiment_runs": Table("run_id string not null, experiment_round_id string not null, corpus_snapshot_id string not null, git_commit string not null, parser_version string not null, chunker_version string not null, chunking_config_id string not null, embedding_model_id string not null, search_backend_id string not null, index_snapshot_id string not null, gold_revision string not null, fact_coverage_snapshot_id string not null, random_seed bigint not null, configuration string not null, metrics string not null, started_at timestamp not null, completed_at timestamp", ("run_id",), (), (_SNAPSHOT, ("fact_coverage_snapshot_id", "fact_coverage_snapshots", "fact_coverage_snapshot_id"))),
    "evaluation_usage_events": Table("usage_event_id string not null, question_id string, assignment_id string not null, run_id string not null, usage_kind string not null, executed_split string not null, used_at timestamp not null, split_lock_status_at_use string not null, chain_ids_at_use array<string> not null, git_commit string, configuration_sha256 string, notes string", ("usage_event_id",), (), (("question_id", "evaluation_questions", "question_id"), ("run_id", "experiment_runs", "run_id"))),
}


@cache
def schema(table: str) -> StructType:
    """A table's columns; those that must not be null say so."""
    return StructType.fromDDL(TABLES[table].ddl)


def problems(df: DataFrame, table: str, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, key, message) of what breaks a table: null columns, repeated keys, CHECK rules, and references to ``others`` by table name.

    Counts of keys are made before anything is compared, so a key that occurs very often is one row.
    """
    t = TABLES[table]
    key = F.concat_ws("/", *t.key)
    rows = df.withColumn("_key", key)
    nulls = {f"{f.name.upper()}_NOT_NULL": (F.col(f.name).isNull(), f"{f.name} is null") for f in schema(table) if not f.nullable}
    found = [violations(rows, "_key", nulls)]
    if table in CHECKS:
        found.append(checks(rows, table, "_key"))
    for names in (t.key, *t.unique):
        again = df.groupBy(*names).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        again = again.filter(" and ".join(f"{n} is not null" for n in names))
        found.append(again.select(F.lit("_".join(names).upper() + "_UNIQUE").alias("rule"), F.concat_ws("/", *names).alias("key"), F.concat(F.lit("occurs "), F.col("n").cast("string"), F.lit(" times")).alias("message")))
    for column, other, other_key in t.refers:
        if other in (others or {}):
            found.append(foreign_keys(rows, column, "_key", others[other], other_key))
    return all_of(*found)
