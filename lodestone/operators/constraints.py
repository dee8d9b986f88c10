"""Validators: each is a set of rules over one table, and gives (rule, key, message) of what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as v
from lodestone.functions.values import same_members
from lodestone.operators.coverage import all_of, violations
from lodestone.sources.shared import dealt

SHA = "^[0-9a-f]{64}$"


def _missing(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def _outside(name: str, values) -> Column:
    return ~F.col(name).isin(list(values)) | F.col(name).isNull()


def _shape(name: str, pattern: str) -> Column:
    return F.col(name).isNull() | ~F.col(name).rlike(pattern)


def required(names: list[str]) -> dict[str, tuple[Column, str]]:
    return {f"{n}_REQUIRED": (_missing(n), f"{n} is missing") for n in names}


def enums(values: dict[str, tuple]) -> dict[str, tuple[Column, str]]:
    return {f"{n}_ENUM": (_outside(n, x), f"{n} is not one of its values") for n, x in values.items()}


def manifest(df: DataFrame) -> DataFrame:
    rules = required(["doc_id", "report_name", "file_path"]) | enums({"doc_group": v.DOCUMENT_GROUPS})
    rules["CORP_CODE"] = (_shape("corp_code", r"^\d{8}$"), "corp_code must have 8 digits")
    rules["STOCK_CODE"] = (F.col("stock_code").isNotNull() & ~F.col("stock_code").rlike(r"^\d{6}$"), "stock_code must have 6 digits")
    rules["RECEIPT"] = (_shape("rcept_no", r"^\d{14}$"), "rcept_no must have 14 digits")
    rules["RECEIPT_DATE"] = (F.try_to_date("rcept_dt", "yyyyMMdd").isNull(), "rcept_dt is not a date")
    rules["DOC_ID"] = (~F.col("doc_id").eqNullSafe(F.concat_ws("_", "doc_group", "rcept_no")), "doc_id is not group and receipt number")
    return violations(df, "doc_id", rules)


def _any(items: Column, bad) -> Column:
    """Whether ``bad`` holds of an item of an array; not of a null array."""
    return F.coalesce(F.exists(items, bad), F.lit(False))


def _repeats(items: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(items)) < F.size(items), F.lit(False))


def _empty(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) < 1


def _blank(x: Column) -> Column:
    return x.isNull() | (x == "")


def evaluation_record(df: DataFrame) -> DataFrame:
    """Rules of any question: (question_id, evaluation_group_id, split, question, question_type, difficulty, answer_mode,
    expected_answerability, doc_groups, required_evidence_slots, gold_document_ids, tags, as_of_date); gold_chunk_ids is forbidden."""
    return violations(df, "question_id", _record_rules(df))


def _record_rules(df: DataFrame) -> dict[str, tuple[Column, str]]:
    slots = F.col("required_evidence_slots")
    rules = required(["question_id", "evaluation_group_id", "split", "question", "question_type", "difficulty", "answer_mode", "expected_answerability"])
    rules |= enums({"split": v.SPLITS, "expected_answerability": v.ANSWERABILITY})
    rules["DOC_GROUPS"] = (_empty(F.col("doc_groups")) | _any(F.col("doc_groups"), lambda g: ~F.coalesce(g.isin(list(v.DOCUMENT_GROUPS)), F.lit(False))), "doc_groups must be known groups, at least one")
    rules["SLOTS"] = (slots.isNull() | _any(slots, lambda s: _blank(s["slot_name"]) | s["acceptable_sources"].isNull()), "each slot needs a name and an array of sources")
    rules["SLOT_NAMES"] = (_repeats(F.transform(slots, lambda s: s["slot_name"])), "slot names must differ")
    for name in ("gold_document_ids", "tags"):
        rules[name.upper()] = (F.col(name).isNull(), f"{name} must be an array")
    rules["AS_OF_DATE"] = (F.col("as_of_date").isNotNull() & ~F.col("as_of_date").cast("string").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "as_of_date must be a day")
    if "gold_chunk_ids" in df.columns:
        rules["CHUNK_IDS"] = (F.col("gold_chunk_ids").isNotNull(), "gold_chunk_ids is forbidden")
    return rules


def slots_sha256(slots: Column) -> Column:
    """The hash that locks required fact slots: of their canonical JSON, keys sorted."""
    return F.sha2(F.to_json(F.transform(slots, lambda s: F.struct(s["metric_code"].alias("metric_code"), s["period_key"].alias("period_key"), s["scope"].alias("scope"), s["slot_name"].alias("slot_name")))), 256)


def gold_record(df: DataFrame) -> DataFrame:
    """Rules of a gold question: those of any question, and of its expected answer, locked slots, routes and scoring.

    Besides: schema_version, expected_fact_ids, expected_event_ids, expected_answer (status, value, unit, reason_code),
    authored_against (six names, manifest_sha256), execution (states, slots, slots_sha256, lock_status, routes) and
    scoring (comparator, tolerance, unit, rounding).
    """
    rules = _record_rules(df) | enums({"question_type": v.QUESTION_TYPES})
    answer, authored, run, scoring = (F.col(c) for c in ("expected_answer", "authored_against", "execution", "scoring"))
    rules["SCHEMA_VERSION"] = (~F.col("schema_version").eqNullSafe("0.2.0"), "schema_version must be 0.2.0")
    for name in ("expected_fact_ids", "expected_event_ids"):
        rules[name.upper()] = (F.col(name).isNull(), f"{name} must be an array")
    rules["ANSWER_STATUS"] = (answer.isNull() | ~F.coalesce(answer["status"].isin(list(v.ANSWERABILITY)), F.lit(False)), "the answer's status is not known")
    rules["ANSWER_AGREES"] = (~answer["status"].eqNullSafe(F.col("expected_answerability")), "the answer's status must be the expected answerability")
    rules["SLOT_TEXTS"] = (_any(F.col("required_evidence_slots"), lambda s: _blank(s["description"]) | _any(s["acceptable_sources"], lambda x: _blank(x["document_id"]) | _blank(x["source_locator"]) | _blank(x["evidence_span"]))), "slots need descriptions, and sources a document, locator and span")
    for name in ("corpus_snapshot_id", "manifest_sha256", "parser_name", "parser_version", "document_ir_schema_version", "semantic_bundle_schema_version", "gold_revision"):
        rules[f"AUTHORED_{name.upper()}"] = (authored.isNull() | _blank(authored[name]), f"authored_against.{name} is missing")
    rules["AUTHORED_BUNDLE"] = (~authored["semantic_bundle_schema_version"].eqNullSafe("0.2.0"), "the semantic bundle's version must be 0.2.0")
    rules["AUTHORED_HASH"] = (F.coalesce(authored["manifest_sha256"] != "", F.lit(False)) & ~authored["manifest_sha256"].rlike(SHA), "manifest_sha256 is not a hash")
    states, routes = run["states"], run["routes"]
    mapped = F.transform(routes, lambda r: r["when"])
    known = lambda x, names: F.coalesce(x.isin(list(names)), F.lit(False))
    rules["STATES"] = (_empty(states) | _any(states, lambda x: ~known(x, v.FACT_COVERAGE_STATES)), "applicable states must be known, at least one")
    rules["STATES_DIFFER"] = (_repeats(states), "applicable states must differ")
    rules["FACT_SLOTS"] = (run["slots"].isNull() | _any(run["slots"], lambda s: _blank(s["slot_name"]) | _blank(s["metric_code"])), "fact slots need a name and a metric")
    rules["FACT_SLOTS_HASH"] = (run["slots"].isNotNull() & ~run["slots_sha256"].eqNullSafe(slots_sha256(run["slots"])), "the hash is not that of the slots")
    rules["FACT_SLOTS_LOCK"] = (~run["lock_status"].eqNullSafe("GOLD_LOCKED"), "fact slots must be locked")
    rules["ROUTES"] = (_empty(routes), "at least one route is needed")
    rules["ROUTE_STATES"] = (_any(mapped, lambda x: ~known(x, v.FACT_COVERAGE_STATES)) | _repeats(mapped), "routes are for known states, one each")
    rules["ROUTE_ALLOWED"] = (_any(routes, lambda r: ~known(r["preferred_route"], v.ROUTES) | ~F.coalesce(F.array_contains(r["allowed_routes"], r["preferred_route"]), F.lit(False)) | _any(r["allowed_routes"], lambda x: ~known(x, v.ROUTES))), "the preferred route must be allowed, and all be known")
    rules["ROUTE_OPERATIONS"] = (_any(routes, lambda r: r["required_operations"].isNull() | r["forbidden_operations"].isNull()), "operations must be arrays")
    rules["ROUTE_ANSWERS"] = (_any(routes, lambda r: ~known(r["expected_answerability"], v.ANSWERABILITY)), "a route's answerability is not known")
    rules["ROUTES_COVER"] = (F.coalesce(~same_members(states, mapped), F.lit(False)), "applicable states and states with routes must be the same")
    rules["COMPARATOR"] = (scoring.isNull() | ~known(scoring["comparator"], v.COMPARATORS), "the comparator is not known")
    rules["POINTS_UNIT"] = ((scoring["comparator"] == "PERCENTAGE_POINT") & ~scoring["unit"].eqNullSafe("%p"), "percentage points need the unit %p")
    return violations(df, "question_id", rules)


def fact_coverage(df: DataFrame) -> DataFrame:
    rules = required(["slot_key"]) | enums({"state": v.FACT_COVERAGE_STATES})
    rules["CONFLICT_NEEDS_TWO"] = ((F.col("state") == "CONFLICTING_VERIFIED_FACTS") & (F.size("fact_ids") < 2), "a conflict needs two facts")
    rules["VERIFIED_NEEDS_ONE"] = ((F.col("state") == "ALL_REQUIRED_FACT_SLOTS_VERIFIED") & (F.size("fact_ids") < 1), "a verified slot needs a fact")
    rules["NONE_HAS_NONE"] = (F.col("state").isin("NO_STRUCTURED_FACT_COVERAGE", "ZERO_DOCUMENT_IN_CORPUS") & (F.size("fact_ids") > 0), "a slot without coverage has no facts")
    return violations(df, "slot_key", rules)


def experiment(df: DataFrame) -> DataFrame:
    rules = required(["run_id", "round_id", "config_sha256"]) | enums({"purpose": v.RUN_PURPOSES})
    rules["CONFIG_HASH"] = (_shape("config_sha256", SHA), "config_sha256 is not a hash")
    rules["COMMIT"] = (_shape("git_commit", "^[0-9a-f]{40}$"), "git_commit is not a commit")
    return violations(df, "run_id", rules)


def usage_event(df: DataFrame) -> DataFrame:
    """Rules of one event of the usage log, whatever way it came there: (usage_event_id, usage_kind, executed_split, run_purpose,
    run_outcome, split_lock_status_at_use, assigned_split_at_use, holdout_lifecycle_status_at_use, chain_ids_at_use,
    previous_log_hash, event_hash)."""
    official = F.col("executed_split") != "SANDBOX"
    purpose, state = F.col("run_purpose"), F.col("holdout_lifecycle_status_at_use")
    rules = enums({"usage_kind": tuple(v.USAGE_KINDS), "executed_split": ("SANDBOX", *v.SPLITS), "split_lock_status_at_use": v.SPLIT_LOCKS, "assigned_split_at_use": v.SPLITS, "holdout_lifecycle_status_at_use": v.HOLDOUT_STATES, "run_purpose": v.RUN_PURPOSES, "run_outcome": v.RUN_OUTCOMES})
    wrong_kind, wrong_purpose = F.lit(False), F.lit(False)
    for kind, split in v.USAGE_KINDS.items():
        wrong_kind |= (F.col("usage_kind") == kind) & ~F.col("executed_split").eqNullSafe(split)
    for name, splits in v.PURPOSE_SPLITS.items():
        wrong_purpose |= (purpose == name) & ~F.coalesce(F.col("executed_split").isin(list(splits)), F.lit(False))
    rules["KIND_OF_SPLIT"] = (wrong_kind, "the kind of use is not that of the split")
    rules["PURPOSE_OF_SPLIT"] = (wrong_purpose, "the purpose is not one of the split")
    rules["LOCKED"] = (official & ~F.coalesce(F.col("split_lock_status_at_use").isin("LOCKED_BY_CHAIN", "LOCKED_BY_COVERAGE"), F.lit(False)), "official use needs a locked assignment")
    rules["ASSIGNED"] = (official & ~F.col("assigned_split_at_use").eqNullSafe(F.col("executed_split")), "official use is of the assigned split")
    rules["CHAINS"] = (F.col("chain_ids_at_use").isNull(), "chain_ids_at_use must be an array")
    rules["FINAL_IS_OPENED"] = ((purpose == "FINAL_HOLDOUT_EVALUATION") & ~state.eqNullSafe("OPENED"), "a final evaluation is of an opened holdout")
    rules["DIAGNOSTIC_STATE"] = ((purpose == "DIAGNOSTIC_ONLY") & ~state.eqNullSafe("DIAGNOSTIC_ONLY"), "diagnostic use is of a diagnostic holdout")
    rules["PREVIOUS_HASH"] = (F.col("previous_log_hash").isNotNull() & ~F.col("previous_log_hash").rlike(SHA), "previous_log_hash is not a hash")
    rules["EVENT_HASH"] = (_shape("event_hash", SHA), "event_hash is not a hash")
    return violations(df, "usage_event_id", rules)


def lifecycle(df: DataFrame) -> DataFrame:
    rules = required(["assignment_id"]) | enums({"assigned_split": v.SPLITS, "lock_status": v.SPLIT_LOCKS})
    rules["HOLDOUT_STATE"] = ((F.col("assigned_split") == "HOLDOUT") & _outside("holdout_status", v.HOLDOUT_STATES), "a holdout assignment needs a state")
    rules["NO_HOLDOUT_STATE"] = ((F.col("assigned_split") != "HOLDOUT") & F.col("holdout_status").isNotNull(), "only holdout assignments have a state")
    return violations(df, "assignment_id", rules)


def relation(df: DataFrame) -> DataFrame:
    """What a recommendation must hold, whoever made it: (relation_id, relation_type, source_id, target_id, candidates, evidence,
    coverage_state, machine_status, basis, review_status)."""
    status, target, parsed = F.col("machine_status"), F.col("target_id"), F.col("coverage_state").eqNullSafe("PRESENT")
    needs = status.isin("READY_FOR_HUMAN_REVIEW", "BLOCKED_UNTIL_TARGET_AMENDS_REVIEW")
    explicit = _any(F.col("basis"), lambda x: x.startswith("EXPLICIT_REFERENCE_"))
    rules = required(["relation_id", "source_id"]) | enums({"relation_type": v.RELATION_TYPES})
    rules["SELF"] = (F.col("source_id") == target, "a document cannot relate to itself")
    rules["TARGET_REQUIRED"] = (needs & target.isNull(), "this status needs a target")
    rules["TARGET_FORBIDDEN"] = (~needs & target.isNotNull(), "this status must not have a target")
    rules["BLOCKED_NEEDS_FAILURE"] = ((status == "PARSE_BLOCKED") & parsed, "a blocked parse is of a source that is not fully parsed")
    rules["FAILURE_IS_BLOCKED"] = ((status != "PARSE_BLOCKED") & ~parsed, "a source that is not fully parsed is blocked")
    rules["EVIDENCE"] = ((needs | (status == "TARGET_OUTSIDE_CORPUS_REVIEW") | (F.col("relation_type") == "TERMINATES") | explicit) & _empty(F.col("evidence")), "evidence of the source is needed")
    rules["TARGET_IS_CANDIDATE"] = (target.isNotNull() & ~F.coalesce(F.array_contains("candidates", target), F.lit(False)), "the target must be one of the candidates")
    rules["PENDING_ONLY"] = (~F.col("review_status").eqNullSafe("PENDING_HUMAN_REVIEW"), "a recommendation holds no human decision")
    return violations(df, "relation_id", rules)


def index_snapshot(df: DataFrame) -> DataFrame:
    """Rules of an index manifest: (schema_version, index_snapshot_id, corpus_snapshot_id, chunking_config_id, created_at,
    components: array of (component_role, embedding_model_id), hybrid_combination)."""
    parts = F.col("components")
    roles = F.transform(parts, lambda c: c["component_role"])
    rules = required(["index_snapshot_id", "corpus_snapshot_id", "chunking_config_id", "created_at"])
    rules["SCHEMA_VERSION"] = (~F.col("schema_version").eqNullSafe("0.1.0"), "schema_version must be 0.1.0")
    rules["COMPONENTS"] = (_empty(parts), "at least one component is needed")
    rules["ROLES"] = (_any(roles, lambda r: ~F.coalesce(r.isin(list(v.INDEX_ROLES)), F.lit(False))), "a component's role is not known")
    rules["ROLES_DIFFER"] = (_repeats(roles), "roles must differ")
    rules["DENSE_MODEL"] = (_any(parts, lambda c: (c["component_role"] == "DENSE") & c["embedding_model_id"].isNull()), "a dense component needs a model")
    rules["HYBRID_PARTS"] = (F.col("hybrid_combination").isNotNull() & (F.coalesce(F.size(F.array_intersect(roles, F.array(F.lit("LEXICAL"), F.lit("DENSE")))), F.lit(0)) < 2), "a hybrid needs a lexical and a dense component")
    return violations(df, "index_snapshot_id", rules)


#: What a retrieval request and its result must agree in. Fixed values.
PAIR_FIELDS = ("query_id", "retrieval_method", "corpus_snapshot_id", "chunking_config_id", "index_snapshot_id", "top_k")


def request_result_pair(df: DataFrame) -> DataFrame:
    """Pairs (pair_id, request, result) that differ in a field, or whose applied filters (maps of arrays) are not those asked for."""
    rules = {f"{n.upper()}_AGREES": (~F.col(f"request.{n}").eqNullSafe(F.col(f"result.{n}")), f"{n} differs between request and result") for n in PAIR_FIELDS}
    plain = lambda m: F.to_json(F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,array<string>>")))))
    rules["FILTERS_AGREE"] = (plain(F.col("request.metadata_filters")) != plain(F.col("result.applied_filters")), "applied filters are not those of the request")
    return violations(df, "pair_id", rules)


#: CHECK constraints of the relational tables, as conditions that hold; unknown counts as holding. Fixed values.
CHECKS = {
    "corpus_snapshots": {"MANIFEST_HASH": "manifest_sha256 RLIKE '^[0-9a-f]{64}$'", "UNIVERSE_HASH": "universe_sha256 RLIKE '^[0-9a-f]{64}$'", "DOCUMENTS": "document_count >= 0"},
    "companies": {"CORP_CODE": "corp_code RLIKE '^[0-9]{8}$'", "STOCK_CODE": "stock_code RLIKE '^[0-9]{6}$'", "FISCAL_MONTH": "fiscal_month BETWEEN 1 AND 12"},
    "company_aliases": {"ALIAS_TYPE": "alias_type IN ('DART_NAME', 'LISTED_NAME', 'STOCK_CODE', 'ENGLISH', 'HISTORICAL', 'MANUAL')"},
    "documents": {"RECEIPT": "receipt_number RLIKE '^[0-9]{14}$'", "BASE_MONTH": "base_month BETWEEN 1 AND 12", "FILES": "declared_file_count > 0", "DOCUMENT_ID": "document_id = concat(doc_group, '_', receipt_number)"},
    "files": {"FORMAT": "detected_format IN ('XML', 'HTML', 'PDF', 'UNKNOWN')", "SIZE": "byte_size >= 0", "HASH": "content_sha256 RLIKE '^[0-9a-f]{64}$'"},
    "parse_runs": {"CHARACTERS": "extracted_char_count >= 0", "WARNINGS": "warning_count >= 0", "ERRORS": "error_count >= 0"},
    "coverage": {"STATE": "state IN ('PARSE_FAILED', 'PARTIAL_PARSE_FAILURE', 'PRESENT') OR document_id IS NULL"},
    "sections": {"ORDINAL": "ordinal >= 0"},
    "evaluation_usage_events": {
        "KIND": "usage_kind IN ('SANDBOX', 'TUNING', 'CHECKPOINT', 'FINAL_HOLDOUT')",
        "SPLIT": "executed_split IN ('SANDBOX', 'DEV_TUNE', 'DEV_CHECK', 'HOLDOUT')",
        "LOCK": "split_lock_status_at_use IN ('PROVISIONAL_UNTIL_CHAIN_CLOSURE', 'LOCKED_BY_CHAIN', 'LOCKED_BY_COVERAGE')",
        "CONFIGURATION": "configuration_sha256 RLIKE '^[0-9a-f]{64}$'",
        "OFFICIAL_IS_LOCKED": "executed_split = 'SANDBOX' OR split_lock_status_at_use IN ('LOCKED_BY_CHAIN', 'LOCKED_BY_COVERAGE')",
        "KIND_OF_SPLIT": "(usage_kind, executed_split) IN (('SANDBOX', 'SANDBOX'), ('TUNING', 'DEV_TUNE'), ('CHECKPOINT', 'DEV_CHECK'), ('FINAL_HOLDOUT', 'HOLDOUT'))",
    },
    "chunks": {"ORDINAL": "ordinal >= 0", "TOKENS": "token_count > 0", "FINGERPRINT": "content_fingerprint RLIKE '^[0-9a-f]{64}$'"},
    "document_events": {"RELATION": "relation_type = 'DISCLOSES'", "CONFIDENCE": "confidence BETWEEN 0 AND 1"},
    "evidence": {"QUOTE_HASH": "quote_sha256 RLIKE '^[0-9a-f]{64}$'", "CONFIDENCE": "confidence BETWEEN 0 AND 1"},
    "document_relations": {"CONFIDENCE": "confidence BETWEEN 0 AND 1", "VERIFIED": "verification_status = 'VERIFIED'", "SELF": "source_document_id <> target_document_id"},
    "document_relation_candidates": {"REVIEW": "review_status IN ('PENDING', 'ACCEPTED', 'REJECTED', 'TARGET_OUTSIDE_CORPUS', 'PARSE_BLOCKED')"},
    "facts": {
        "RAW_VALUE": "trim(raw_value_text) <> ''",
        "CONFIDENCE": "confidence BETWEEN 0 AND 1",
        "DISCLOSED_VALUE": "value_status <> 'DISCLOSED' OR CASE value_type WHEN 'NUMERIC' THEN numeric_value IS NOT NULL WHEN 'TEXT' THEN text_value IS NOT NULL WHEN 'DATE' THEN date_value IS NOT NULL WHEN 'BOOLEAN' THEN boolean_value IS NOT NULL ELSE FALSE END",
        "WITHHELD_UNTIL": "value_status = 'WITHHELD' OR withheld_until IS NULL",
    },
    "fact_coverage_snapshots": {"PAYLOAD_HASH": "payload_sha256 RLIKE '^[0-9a-f]{64}$'"},
    "fact_coverage_snapshot_slots": {"STATE": f"coverage_state IN {v.FACT_COVERAGE_STATES}", "VERIFIED": "verification_status = 'VERIFIED'", "CONFLICT": "coverage_state <> 'CONFLICTING_VERIFIED_FACTS' OR size(fact_ids) >= 2"},
    "evaluation_questions": {"VERSION": "schema_version = '0.2.0'", "DIFFICULTY": "difficulty IN ('EASY', 'MEDIUM', 'HARD')", "MODE": "answer_mode IN ('CLOSED', 'OPEN')"},
}


def checks(df: DataFrame, table: str, key: str) -> DataFrame:
    """Rows of a table that break one of its CHECK constraints."""
    return violations(df, key, {name: (~F.coalesce(F.expr(rule), F.lit(True)), rule) for name, rule in CHECKS[table].items()})


def chunk_parents(chunks: DataFrame) -> DataFrame:
    """Chunks whose parent is not a chunk of the same document."""
    known = chunks.select(F.col("chunk_id").alias("p"), F.col("document_id").alias("d"))
    bad = chunks.filter("parent_chunk_id is not null").join(known, (F.col("parent_chunk_id") == F.col("p")) & (F.col("document_id") == F.col("d")), "left_anti")
    return bad.select(F.lit("PARENT_EXISTS").alias("rule"), F.col("chunk_id").alias("key"), F.lit("its parent is not in its document").alias("message"))


def foreign_keys(child: DataFrame, column: str, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    known = parent.select(F.col(parent_key).alias("_p")).distinct()
    bad = child.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_p"), "left_anti")
    return bad.select(F.lit(f"{column.upper()}_EXISTS").alias("rule"), F.col(key).cast("string").alias("key"), F.lit(f"{column} has no {parent_key}").alias("message"))


def unique(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(f"{key.upper()}_UNIQUE").alias("rule"), F.col(key).cast("string").alias("key"), F.concat(F.lit("occurs "), F.col("n").cast("string"), F.lit(" times")).alias("message"))


def release_lock(lock: DataFrame, found: DataFrame) -> DataFrame:
    """Differences between a lock (path, n_bytes, sha256) and what is there; a task holds bounded parts of both, by path."""
    here = found.select(F.col("path").alias("p"), F.col("n_bytes").alias("b"), F.col("sha256").alias("h"))
    lock, here = dealt((lock.select("path", "n_bytes", "sha256"), ["path"]), (here, ["p"]))
    same = F.col("path") == F.col("p")
    left = lock.join(here, same, "left_anti").select("path").distinct().select(F.lit("FILE_LEFT_ONLY").alias("rule"), F.col("path").alias("key"))
    right = here.join(lock, same, "left_anti").select("p").distinct().select(F.lit("FILE_RIGHT_ONLY").alias("rule"), F.col("p").alias("key"))
    sides = left.unionByName(right).withColumn("message", F.lit("stands on one side only"))
    changed = violations(lock.join(here, same), "path", {"SIZE": (F.col("n_bytes") != F.col("b"), "size differs"), "HASH": (F.col("sha256") != F.col("h"), "hash differs")})
    return all_of(sides, changed)


def harness_config(config: dict) -> list[str]:
    """What is wrong with a harness configuration; a plain check of one small dictionary."""
    bad = [f"{k} is missing" for k in ("gold_path", "output_path", "ledger_path", "base_url") if not config.get(k)]
    paths = [config.get(k) for k in ("gold_path", "output_path", "ledger_path") if config.get(k)]
    if len(set(paths)) < len(paths):
        bad.append("paths must differ")
    if not 1 <= int(config.get("concurrency", 1)) <= 64:
        bad.append("concurrency must be between 1 and 64")
    split, purpose = config.get("split"), config.get("run_purpose")
    if split is not None and split not in ("SANDBOX", *v.SPLITS):
        bad.append("split is not known")
    if purpose is not None and split not in v.PURPOSE_SPLITS.get(purpose, ()):
        bad.append("run_purpose is not one of the split")
    if float(config.get("timeout_ms", 1)) <= 0:
        bad.append("timeout_ms must be positive")
    return bad
