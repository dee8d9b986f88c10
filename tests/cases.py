"""Operators over small tables of cases, with the same question, or the rows they must give, in SQL.

Each table stands in the case and, as VALUES, in its SQL; test_cases.py compares both.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import ids, markup, text, values
from lodestone.operators import chunking, constraints, evaluation, ledger, retrieval, reviews
from lodestone.sources import schemas


CASES: dict[str, tuple] = {}


def query(sql: str):
    """Note a function of (read) with its SQL; ``read`` gives a table of the smallest size."""

    def note(f):
        CASES[f.__name__] = (f, sql)
        return f

    return note


def _sql(x) -> str:
    """A value as a DuckDB literal."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, dict):
        return "{" + ", ".join(f"'{k}': {_sql(v)}" for k, v in x.items()) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_sql, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def _names(ddl: str) -> list[str]:
    flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", ddl)))
    return [c.split()[0] for c in flat.split(",")]


class Cases:
    """A table of cases: a DataFrame, and a table expression in SQL."""

    def __init__(self, ddl: str, rows: list[tuple]) -> None:
        self.ddl, self.rows = ddl, rows

    def __call__(self, read: Callable[[str], DataFrame]) -> DataFrame:
        return read("region").sparkSession.createDataFrame(self.rows, self.ddl)

    def __str__(self) -> str:
        return "(VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in self.rows) + f") AS t({', '.join(_names(self.ddl))})"


def expected(names: str, rows: list[tuple]) -> str:
    """SQL that gives the rows themselves."""
    kinds = [c.split(":") for c in names.split()]
    return f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in kinds)} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS t({', '.join(n for n, _ in kinds)})"


_SCORES = Cases(
    "id int, kind string, comparator string, number double, tolerance double, low double, high double, flag boolean, words string, result string, value string, answer string",
    [
        (1, "number", "EXACT", 10.0, None, None, None, None, None, "10", None, None),
        (2, "number", "EXACT", 10.0, 0.5, None, None, None, None, "10.4", None, None),
        (3, "number", "ABSOLUTE", 10.0, None, None, None, None, None, "10.1", None, None),
        (4, "number", "RELATIVE", -200.0, 0.1, None, None, None, None, "-219", None, None),
        (5, "number", "RELATIVE", 0.0, 0.5, None, None, None, None, "0.1", None, None),
        (6, "number", "PERCENTAGE_POINT", 3.5, 0.2, None, None, None, None, None, "3.6", None),
        (7, "number", "RANGE", None, None, 1.0, 2.0, None, None, "2", None, None),
        (8, "number", "RANGE", None, None, 1.0, 2.0, None, None, "2.01", None, None),
        (9, "number", "RANGE", None, None, 1.0, None, None, None, "1.5", None, None),
        (10, "number", "EXACT", 10.0, None, None, None, None, None, None, None, "the answer is 10"),
        (11, "number", "EXACT", 10.0, None, None, None, None, None, "about 10", "10", None),
        (12, "flag", None, None, None, None, None, True, None, "true", None, None),
        (13, "flag", None, None, None, None, None, True, None, "false", None, None),
        (14, "flag", None, None, None, None, None, False, None, None, None, "no"),
        (15, "words", None, None, None, None, None, None, "Alpha", "Alpha", None, "Beta"),
        (16, "words", None, None, None, None, None, None, "Alpha", "alpha", None, "Alpha"),
        (17, "words", None, None, None, None, None, None, "Alpha", None, None, "it is Alpha indeed"),
        (18, "words", None, None, None, None, None, None, "Alpha", None, None, None),
    ],
)


@query(rf"""
    WITH c AS (SELECT *, TRY_CAST(CASE WHEN result IS NOT NULL THEN result ELSE value END AS DOUBLE) AS n, coalesce(result, value) AS s FROM {_SCORES})
    SELECT id, CASE
        WHEN kind = 'number' AND comparator = 'RANGE' THEN CASE WHEN low IS NULL OR high IS NULL OR n IS NULL THEN 'NOT_SCORED' WHEN n >= low AND n <= high THEN 'PASS' ELSE 'FAIL' END
        WHEN kind = 'number' THEN CASE WHEN number IS NULL OR n IS NULL THEN 'NOT_SCORED' WHEN abs(n - number) <= coalesce(tolerance, 0) * (CASE WHEN comparator = 'RELATIVE' THEN abs(number) ELSE 1 END) THEN 'PASS' ELSE 'FAIL' END
        WHEN kind = 'flag' THEN CASE WHEN s IS NULL OR s NOT IN ('true', 'false') THEN 'NOT_SCORED' WHEN (s = 'true') = flag THEN 'PASS' ELSE 'FAIL' END
        ELSE CASE WHEN s IS NOT NULL THEN (CASE WHEN s = words THEN 'PASS' ELSE 'FAIL' END) WHEN answer IS NOT NULL THEN (CASE WHEN contains(answer, words) THEN 'PASS' ELSE 'FAIL' END) ELSE 'NOT_SCORED' END END AS status
    FROM c
""")
def closed_scoring_cases(read):
    n, stated = evaluation.structured_number(F.col("result"), F.col("value")), F.coalesce("result", "value")
    number = evaluation.numeric_match(F.col("comparator"), F.col("number"), n, F.col("tolerance"), F.col("low"), F.col("high"))
    flag = evaluation.boolean_match(F.col("flag"), F.when(stated == "true", True).when(stated == "false", False))
    status = F.when(F.col("kind") == "number", number).when(F.col("kind") == "flag", flag).otherwise(evaluation.text_match(F.col("words"), stated, F.col("answer")))
    return _SCORES(read).select("id", status.alias("status"))


_SOURCE = "array<struct<document_id:string,locator:string,quote:string>>"
_SLOTS = Cases(
    f"question_id int, slot_id string, sources {_SOURCE}",
    [
        (1, "a", [{"document_id": "d1", "locator": "L1", "quote": "q one"}]),
        (1, "b", [{"document_id": "d2", "locator": "L2", "quote": "q two"}, {"document_id": "d3", "locator": "L3", "quote": "q three"}]),
        (1, "none", []),
        (2, "a", [{"document_id": "d1", "locator": "L1", "quote": "q one"}]),
        (3, "a", [{"document_id": "d1", "locator": "L1", "quote": "q one"}]),
        (4, "a", [{"document_id": "d1", "locator": "L1", "quote": "q one"}]),
        (5, "a", [{"document_id": "d1", "locator": "L1", "quote": "q one"}]),
    ],
)
_VERIFIED = Cases(
    "question_id int, slot_id string, evidence_id string, document_id string, locator string, quote_sha256 string",
    [(q, s, "e1", "d1", "L1", "42c1a8d0c0b0f4ad50b9fa6ba8af6bf0a5a9e4bcb6ffb3c6b0e3ac1b4a51e8b3") for q, s in ((2, "a"), (3, "a"), (4, "a"), (1, "none"))],
)
_CONTEXTS = Cases(
    "question_id int, evidence_id string, document_id string, locator string, quote string",
    [
        (1, None, "d1", "L1", "q one"),
        (1, "", "d3", "L3", "q three"),
        (1, "e1", None, None, None),
        (2, "e1", None, None, None),
        (3, "e1", "d9", "L1", None),  # names evidence, contradicts its document
        (3, "e2", "d1", "L1", "q one"),  # names unknown evidence: never judged by its place
        (4, "e1", "d1", "L1", "another quote"),  # contradicts the quote's hash
        (5, None, "d1", "L9", "q one"),
    ],
)


@query(f"""
    WITH s AS (SELECT * FROM {_SLOTS}), c AS (SELECT * FROM {_CONTEXTS}), v AS (SELECT * FROM {_VERIFIED})
    SELECT question_id, slot_id, len(sources) > 0 AND (
        EXISTS (SELECT 1 FROM c JOIN v ON v.question_id = c.question_id AND v.evidence_id = c.evidence_id WHERE c.question_id = s.question_id AND v.slot_id = s.slot_id AND coalesce(c.document_id = v.document_id, TRUE) AND coalesce(c.locator = v.locator, TRUE) AND coalesce(sha256(c.quote) = v.quote_sha256, TRUE))
        OR EXISTS (SELECT 1 FROM c WHERE c.question_id = s.question_id AND coalesce(c.evidence_id, '') = '' AND list_contains(s.sources, {{'document_id': c.document_id, 'locator': c.locator, 'quote': c.quote}}))) AS grounded
    FROM s
""")
def slot_groundedness(read):
    return evaluation.groundedness(_SLOTS(read), _CONTEXTS(read), _VERIFIED(read))


_GOLD = Cases(
    "question_id int, fields map<string,string>, documents array<string>, evidence_ids array<string>",
    [
        (1, {"name": "Alpha Corp", "day": "2024-03-05", "n": None, "x": "A"}, ["d1", "d2"], ["e1"]),
        (2, {"name": "Alpha Corp", "other": "Beta"}, ["d1"], ["e1"]),
        (3, {"x": "A"}, ["d1"], []),
        (4, {}, ["d1"], ["e1"]),
    ],
)
_RESPONSES = Cases(
    "question_id int, answer string, contexts array<struct<document_id:string,evidence_id:string>>",
    [
        (1, "Alpha Corp signed on 2024-03-06", [{"document_id": "d1", "evidence_id": "e1"}, {"document_id": None, "evidence_id": "e9"}]),
        (2, "Alpha Corp only", [{"document_id": "d1", "evidence_id": "e2"}]),
        (3, None, []),
        (4, "x", [{"document_id": "d7", "evidence_id": None}]),
    ],
)


@query(expected(
    "question_id:INTEGER required_evidence_coverage:VARCHAR explicit_fact_value_slots:VARCHAR temporal_requirements:VARCHAR requested_format:VARCHAR claim_coverage:VARCHAR groundedness:VARCHAR",
    [
        (1, "FAIL", "PASS", "FAIL", "NOT_SCORED", "REVIEW_REQUIRED", "PASS"),
        (2, "PASS", "FAIL", "NOT_SCORED", "NOT_SCORED", "REVIEW_REQUIRED", "FAIL"),
        (3, "FAIL", "NOT_SCORED", "NOT_SCORED", "NOT_SCORED", "REVIEW_REQUIRED", "NOT_SCORED"),
        (4, "FAIL", "NOT_SCORED", "NOT_SCORED", "NOT_SCORED", "REVIEW_REQUIRED", "FAIL"),
    ],
))
def open_scoring(read):
    return evaluation.open_scores(_GOLD(read), _RESPONSES(read), slot_groundedness(read))


_CITED = [("ok", "d1", "f1", "L1", "the quote"), ("gone", "d1", "f1", "L1", "the quote"), ("doc", "d2", "f1", "L1", "the quote"), ("loc", "d1", "f1", "L2", "the quote"), ("text", "d1", "f1", "L1", "other"), ("hash", "d1", "f1", "L1", "the quote"), ("open", "d1", "f1", "L1", "the quote"), ("nodoc", "d9", "f1", "L1", "the quote"), ("noblock", "d1", "f1", "L9", "the quote"), ("absent", "d1", "f1", "L1", "absent"), ("old", "d1", "f1", "L1", "the quote")]
_KEPT = {"doc": {"document_id": "d1"}, "loc": {"locator": "L1"}, "text": {"quote": "the quote"}, "open": {"verification_status": "CANDIDATE"}, "old": {"corpus_snapshot_id": "s0"}}


@query(expected("evidence_id:VARCHAR code:VARCHAR", [("ok", "OK"), ("gone", "EVIDENCE_NOT_FOUND"), ("doc", "EVIDENCE_DOCUMENT_MISMATCH"), ("loc", "EVIDENCE_LOCATOR_MISMATCH"), ("text", "EVIDENCE_QUOTE_MISMATCH"), ("hash", "EVIDENCE_HASH_MISMATCH"), ("open", "UNVERIFIED_DATA_FORBIDDEN"), ("nodoc", "DOCUMENT_NOT_FOUND"), ("noblock", "LOCATOR_NOT_FOUND"), ("absent", "QUOTE_MISMATCH"), ("old", "EVIDENCE_SNAPSHOT_MISMATCH")]))
def citation_check(read):
    spark = read("region").sparkSession
    names = ("evidence_id", "document_id", "file_id", "locator", "quote")
    cited = spark.createDataFrame(_CITED, ", ".join(f"{n} string" for n in names)).withColumn("quote_sha256", F.when(F.col("evidence_id") == "hash", "00").otherwise(F.sha2("quote", 256)))
    kept = [dict(zip(names, r, strict=True)) | {"verification_status": "VERIFIED", "corpus_snapshot_id": "s1"} | _KEPT.get(r[0], {}) for r in _CITED if r[0] != "gone"]
    evidence = spark.createDataFrame(kept, ", ".join(f"{n} string" for n in (*names, "verification_status", "corpus_snapshot_id"))).withColumn("quote_sha256", F.sha2("quote", 256))
    blocks = spark.createDataFrame([("d1", "f1", "L1", "here is the quote", "s1")], "document_id string, file_id string, locator string, text string, corpus_snapshot_id string")
    return evaluation.citation_codes(cited, evidence, blocks, "s1")


_QUESTIONS = Cases("question_id string, evaluation_group_id string, split string", [("q1", "g1", "DEV_TUNE"), ("q2", "g1", "DEV_CHECK"), ("q3", "g2", "HOLDOUT"), ("q4", "g3", "HOLDOUT"), ("q5", "g4", "DEV_TUNE")])
_LOCKS = Cases("assignment_id string, lock_status string", [("g1", "PROVISIONAL_UNTIL_CHAIN_CLOSURE"), ("q2", "LOCKED_BY_CHAIN"), ("g2", "LOCKED_BY_COVERAGE"), ("q4", "PROVISIONAL_UNTIL_CHAIN_CLOSURE")])


@query(f"""
    WITH q AS (SELECT * FROM {_QUESTIONS}), l AS (SELECT * FROM {_LOCKS}),
    s AS (SELECT q.*, coalesce((SELECT lock_status FROM l WHERE assignment_id = question_id), (SELECT lock_status FROM l WHERE assignment_id = evaluation_group_id)) AS k FROM q)
    SELECT 'SANDBOX' AS run, question_id FROM s WHERE k LIKE 'PROVISIONAL%' UNION ALL SELECT 'NARROWED', question_id FROM s WHERE k LIKE 'PROVISIONAL%' AND question_id IN ('q4', 'q2') UNION ALL SELECT 'HOLDOUT', question_id FROM s WHERE split = 'HOLDOUT'
""")
def split_eligibility(read):
    q, life = _QUESTIONS(read), _LOCKS(read)
    runs = {"SANDBOX": evaluation.eligible(q, "SANDBOX", life), "NARROWED": evaluation.eligible(q, "SANDBOX", life, ["q4", "q2"]), "HOLDOUT": evaluation.eligible(q, "HOLDOUT"), "NO_LIFECYCLE": evaluation.eligible(q, "SANDBOX")}
    out = None
    for name, rows in runs.items():
        rows = rows.select(F.lit(name).alias("run"), "question_id")
        out = rows if out is None else out.unionByName(rows)
    return out


_RAW = Cases(
    "id int, metric string, kind string, raw string, withheld boolean",
    [(1, "CONTRACT_AMOUNT", "NUMERIC", "2,655,600,000,000(예정)", False), (2, "CONTRACT_AMOUNT", "NUMERIC", "-", True), (3, "CONTRACT_AMOUNT", "NUMERIC", "-", False), (4, "WITHHELD_UNTIL", "DATE", "2030.01.01", True), (5, "CONTRACT_COUNTERPARTY", "TEXT", "해당사항 없음", False), (6, "CONTRACT_SALES_RATIO", "NUMERIC", "12.5", False), (7, "CONTRACT_SALES_RATIO", "NUMERIC", "n/a", True), (8, "CONTRACT_START_DATE", "DATE", "추후 결정", False), (9, "WITHHELD_REASON", "TEXT", "-", True), (10, "CONTRACT_NAME", "TEXT", "공급 계약(잠정)", False)],
)


@query(expected(
    "id:INTEGER status:VARCHAR certainty:VARCHAR numeric_value:DOUBLE date_value:VARCHAR text_value:VARCHAR unit:VARCHAR currency:VARCHAR raw_unit:VARCHAR scale:INTEGER",
    [
        (1, "DISCLOSED", "PLANNED", 2655600000000.0, None, None, "KRW", "KRW", "원", 1),
        (2, "WITHHELD", "NOT_RELEVANT", None, None, None, "KRW", "KRW", "원", 1),
        (3, "MISSING", "NOT_RELEVANT", None, None, None, "KRW", "KRW", "원", 1),
        (4, "DISCLOSED", "CONFIRMED", None, "2030-01-01", None, None, None, None, None),
        (5, "NOT_APPLICABLE", "NOT_RELEVANT", None, None, None, None, None, None, None),
        (6, "DISCLOSED", "CONFIRMED", 12.5, None, None, "PERCENT", None, "%", 1),
        (7, "NOT_APPLICABLE", "NOT_RELEVANT", None, None, None, "PERCENT", None, "%", 1),
        (8, "MISSING", "NOT_RELEVANT", None, None, None, None, None, None, None),
        (9, "MISSING", "NOT_RELEVANT", None, None, None, None, None, None, None),
        (10, "DISCLOSED", "PLANNED", None, None, "공급 계약", None, None, None, None),
    ],
))
def value_cases(read):
    rows = _RAW(read).withColumn("v", values.value_status(F.col("raw"), F.col("kind"), F.col("metric"), F.col("withheld"))).withColumn("u", values.metric_unit(F.col("metric")))
    return rows.select("id", "v.status", "v.certainty", F.col("v.numeric_value").cast("double").alias("numeric_value"), F.col("v.date_value").cast("string").alias("date_value"), "v.text_value", "u.*")


_DAYS = Cases("id int, raw string", [(1, "2024.03.05"), (2, "2024년 3월 5일"), (3, "2024-3-5"), (4, "2024/13/05"), (5, "20240305"), (6, "-"), (7, "2023.02.29"), (8, None)])


@query(rf"""
    WITH c AS (SELECT id, regexp_extract(raw, '^\s*(\d{{4}})\s*[.년/-]\s*(\d{{1,2}})\s*[.월/-]\s*(\d{{1,2}})\s*[.일]?\s*$', ['y', 'm', 'd']) AS p FROM {_DAYS})
    SELECT id, CAST(CASE WHEN p.y <> '' THEN TRY_CAST(p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE) END AS VARCHAR) AS day FROM c
""")
def date_cases(read):
    return _DAYS(read).select("id", text.parse_date(F.col("raw")).cast("string").alias("day"))


_SETS = Cases("id int, a array<string>, b array<string>", [(1, ["c", "a", "c", "b"], ["b", "c"]), (2, ["a"], []), (3, ["x", "y"], ["y", "x", "x"]), (4, [], [])])


@query(f"SELECT id, list_filter(a, lambda x, i: list_contains(b, x) AND list_position(a, x) = i) AS both, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same FROM {_SETS}")
def set_cases(read):
    return _SETS(read).select("id", values.ordered_intersection(F.col("a"), F.col("b")).alias("both"), values.same_members(F.col("a"), F.col("b")).alias("same"))


_LABELS = Cases("label string", [("제100000000000000000000000장",), ("제100000000000000000000001장",), ("Á",), ("제10장",), ("제2장",), ("b2",), ("B10",), ("a",), ("가",), ("b02",)])


@query("SELECT * FROM (VALUES ('가', 1), ('제2장', 2), ('제10장', 3), ('제100000000000000000000000장', 4), ('제100000000000000000000001장', 5), ('a', 6), ('Á', 6), ('b2', 8), ('b02', 8), ('B10', 10)) AS t(label, place)")
def natural_sort(read):
    from pyspark.sql import Window

    rows = _LABELS(read).withColumn("key", values.natural_key(F.col("label")))
    return rows.select("label", F.rank().over(Window.orderBy("key")).alias("place"))


_EVENT = ("DEV_TUNE", "TUNING", "FLOW_SELECTION", "SUCCESS", "LOCKED_BY_CHAIN", "DEV_TUNE", "SEALED", ["c"], None, "a" * 64)
_EVENT_NAMES = ("executed_split", "usage_kind", "run_purpose", "run_outcome", "split_lock_status_at_use", "assigned_split_at_use", "holdout_lifecycle_status_at_use", "chain_ids_at_use", "previous_log_hash", "event_hash")


def _events() -> list[tuple]:
    changes = {
        "good": {}, "kind": {"usage_kind": "CHECKPOINT"}, "lock": {"split_lock_status_at_use": "PROVISIONAL_UNTIL_CHAIN_CLOSURE"}, "assigned": {"assigned_split_at_use": "HOLDOUT"}, "purpose": {"run_purpose": "DIAGNOSTIC_ONLY"},
        "hash": {"event_hash": "xyz", "previous_log_hash": "q"}, "final": {"executed_split": "HOLDOUT", "assigned_split_at_use": "HOLDOUT", "usage_kind": "FINAL_HOLDOUT", "run_purpose": "FINAL_HOLDOUT_EVALUATION"}, "chains": {"chain_ids_at_use": None},
        "sandbox": {"executed_split": "SANDBOX", "usage_kind": "SANDBOX", "run_purpose": "SANDBOX_EXPLORATION", "split_lock_status_at_use": "PROVISIONAL_UNTIL_CHAIN_CLOSURE"}, "outcome": {"run_outcome": "MAYBE"},
    }
    return [(k, *(dict(zip(_EVENT_NAMES, _EVENT, strict=True)) | c).values()) for k, c in changes.items()]


@query(expected("rule:VARCHAR key:VARCHAR", [("KIND_OF_SPLIT", "kind"), ("LOCKED", "lock"), ("ASSIGNED", "assigned"), ("PURPOSE_OF_SPLIT", "purpose"), ("DIAGNOSTIC_STATE", "purpose"), ("PREVIOUS_HASH", "hash"), ("EVENT_HASH", "hash"), ("FINAL_IS_OPENED", "final"), ("CHAINS", "chains"), ("run_outcome_ENUM", "outcome")]))
def usage_event_rules(read):
    ddl = "usage_event_id string, " + ", ".join(f"{n} array<string>" if n == "chain_ids_at_use" else f"{n} string" for n in _EVENT_NAMES)
    return constraints.usage_event(Cases(ddl, _events())(read)).select("rule", "key")


_PART = "array<struct<component_role:string,embedding_model_id:string>>"
_INDEXES = Cases(
    f"schema_version string, index_snapshot_id string, corpus_snapshot_id string, chunking_config_id string, created_at string, components {_PART}, hybrid_combination string",
    [
        ("0.1.0", "good", "s", "c", "t", [{"component_role": "LEXICAL", "embedding_model_id": None}, {"component_role": "DENSE", "embedding_model_id": "m"}], "RRF"),
        ("0.1.0", "model", "s", "c", "t", [{"component_role": "DENSE", "embedding_model_id": None}], None),
        ("0.1.0", "twice", "s", "c", "t", [{"component_role": "LEXICAL", "embedding_model_id": None}, {"component_role": "LEXICAL", "embedding_model_id": None}], None),
        ("0.1.0", "hybrid", "s", "c", "t", [{"component_role": "LEXICAL", "embedding_model_id": None}], "RRF"),
        ("0.2.0", "old", None, "c", "t", [], None),
        ("0.1.0", "role", "s", "c", "t", [{"component_role": "ODD", "embedding_model_id": None}], None),
    ],
)


@query(expected("rule:VARCHAR key:VARCHAR", [("DENSE_MODEL", "model"), ("ROLES_DIFFER", "twice"), ("HYBRID_PARTS", "hybrid"), ("SCHEMA_VERSION", "old"), ("corpus_snapshot_id_REQUIRED", "old"), ("COMPONENTS", "old"), ("ROLES", "role")]))
def index_manifest_rules(read):
    return constraints.index_snapshot(_INDEXES(read)).select("rule", "key")


_SIDE = "query_id:string,retrieval_method:string,corpus_snapshot_id:string,chunking_config_id:string,index_snapshot_id:string,top_k:int"


def _pairs() -> list[tuple]:
    ask = {"query_id": "q", "retrieval_method": "BM25", "corpus_snapshot_id": "s", "chunking_config_id": "c", "index_snapshot_id": "i", "top_k": 5}
    filters = {"corp_code": ["1", "2"], "doc_group": ["periodic"]}
    request = ask | {"metadata_filters": filters}
    turned = {"doc_group": ["periodic"], "corp_code": ["1", "2"]}
    return [("same", request, ask | {"applied_filters": turned}), ("k", request, ask | {"top_k": 6, "applied_filters": filters}), ("filters", request, ask | {"applied_filters": {"corp_code": ["1"]}}), ("none", ask | {"metadata_filters": None}, ask | {"applied_filters": {}})]


@query(expected("rule:VARCHAR key:VARCHAR", [("TOP_K_AGREES", "k"), ("FILTERS_AGREE", "filters")]))
def request_result_rules(read):
    ddl = f"pair_id string, request struct<{_SIDE},metadata_filters:map<string,array<string>>>, result struct<{_SIDE},applied_filters:map<string,array<string>>>"
    return constraints.request_result_pair(Cases(ddl, _pairs())(read)).select("rule", "key")


_GOLD_DDL = (
    "question_id string, evaluation_group_id string, split string, question string, question_type string, difficulty string, answer_mode string, expected_answerability string, doc_groups array<string>, "
    "required_evidence_slots array<struct<slot_name:string,description:string,acceptable_sources:array<struct<document_id:string,source_locator:string,evidence_span:string>>>>, gold_document_ids array<string>, tags array<string>, as_of_date string, "
    "schema_version string, expected_fact_ids array<string>, expected_event_ids array<string>, expected_answer struct<status:string,value:string,unit:string,reason_code:string>, "
    "authored_against struct<corpus_snapshot_id:string,manifest_sha256:string,parser_name:string,parser_version:string,document_ir_schema_version:string,semantic_bundle_schema_version:string,gold_revision:string>, "
    "execution struct<states:array<string>,slots:array<struct<slot_name:string,metric_code:string,period_key:string,scope:string>>,slots_sha256:string,lock_status:string,routes:array<struct<when:string,preferred_route:string,allowed_routes:array<string>,required_operations:array<string>,forbidden_operations:array<string>,expected_answerability:string>>>, "
    "scoring struct<comparator:string,tolerance:double,unit:string,rounding:string>"
)


def _gold_rows() -> list[dict]:
    state = "ALL_REQUIRED_FACT_SLOTS_VERIFIED"
    route = {"when": state, "preferred_route": "STRUCTURED", "allowed_routes": ["STRUCTURED"], "required_operations": [], "forbidden_operations": [], "expected_answerability": "SUPPORTED"}
    run = {"states": [state], "slots": [{"slot_name": "a", "metric_code": "m", "period_key": "p", "scope": "s"}], "slots_sha256": None, "lock_status": "GOLD_LOCKED", "routes": [route]}
    authored = {n: "x" for n in ("corpus_snapshot_id", "parser_name", "parser_version", "document_ir_schema_version", "gold_revision")} | {"manifest_sha256": "0" * 64, "semantic_bundle_schema_version": "0.2.0"}
    slot = {"slot_name": "a", "description": "d", "acceptable_sources": [{"document_id": "d", "source_locator": "l", "evidence_span": "e"}]}
    good = {
        "evaluation_group_id": "g", "split": "DEV_TUNE", "question": "?", "question_type": "SIMPLE_LOOKUP", "difficulty": "EASY", "answer_mode": "CLOSED", "expected_answerability": "SUPPORTED", "doc_groups": ["periodic"], "required_evidence_slots": [slot], "gold_document_ids": [], "tags": [], "as_of_date": None,
        "schema_version": "0.2.0", "expected_fact_ids": [], "expected_event_ids": [], "expected_answer": {"status": "SUPPORTED", "value": "1", "unit": None, "reason_code": None}, "authored_against": authored, "execution": run, "scoring": {"comparator": "EXACT", "tolerance": None, "unit": None, "rounding": None},
    }
    changes = {
        "good": {}, "split": {"split": "TRAIN"}, "groups": {"doc_groups": ["odd"]}, "names": {"required_evidence_slots": [slot, slot]}, "day": {"as_of_date": "2024"}, "version": {"schema_version": "0.1.0"}, "status": {"expected_answer": good["expected_answer"] | {"status": "NOT_FOUND"}},
        "authored": {"authored_against": authored | {"manifest_sha256": "abc", "parser_name": ""}}, "lock": {"execution": run | {"lock_status": "OPEN", "slots_sha256": "bad"}}, "cover": {"execution": run | {"states": [state, "PARSE_BLOCKED"]}}, "route": {"execution": run | {"routes": [route | {"allowed_routes": ["RETRIEVAL"]}]}},
        "points": {"scoring": good["scoring"] | {"comparator": "PERCENTAGE_POINT"}}, "source": {"required_evidence_slots": [slot | {"acceptable_sources": [{"document_id": "d", "source_locator": "", "evidence_span": "e"}]}]},
    }
    return [good | {"question_id": k} | c for k, c in changes.items()]


@query(expected("rule:VARCHAR key:VARCHAR", [("split_ENUM", "split"), ("DOC_GROUPS", "groups"), ("SLOT_NAMES", "names"), ("AS_OF_DATE", "day"), ("SCHEMA_VERSION", "version"), ("ANSWER_AGREES", "status"), ("AUTHORED_HASH", "authored"), ("AUTHORED_PARSER_NAME", "authored"), ("FACT_SLOTS_LOCK", "lock"), ("FACT_SLOTS_HASH", "lock"), ("ROUTES_COVER", "cover"), ("ROUTE_ALLOWED", "route"), ("POINTS_UNIT", "points"), ("SLOT_TEXTS", "source")]))
def gold_record_rules(read):
    rows = read("region").sparkSession.createDataFrame(_gold_rows(), _GOLD_DDL)
    run = F.col("execution")
    rows = rows.withColumn("execution", run.withField("slots_sha256", F.coalesce(run["slots_sha256"], constraints.slots_sha256(run["slots"]))))
    return constraints.gold_record(rows).select("rule", "key")


@query(expected("rule:VARCHAR key:VARCHAR", [("RECEIPT", "periodic_1"), ("BASE_MONTH", "periodic_1"), ("DOCUMENT_ID", "exchange_20240101000001")]))
def table_checks(read):
    rows = [("periodic_20240101000001", "periodic", "20240101000001", 3, 1), ("periodic_1", "periodic", "1", 13, 1), ("exchange_20240101000001", "major", "20240101000001", None, 1)]
    df = read("region").sparkSession.createDataFrame(rows, "document_id string, doc_group string, receipt_number string, base_month int, declared_file_count int")
    return constraints.checks(df, "documents", "document_id").select("rule", "key")


_LINKS = Cases("question_id string, slot_name string, evidence_id string, document_id string, file_id string, locator string, row int, column int", [("q1", "a", "e1", "d1", "f1", "L1", None, None), ("q1", "b", "e2", "d1", "f1", "T1", 1, 2), ("q2", "a", "e3", "d1", "f1", "T1", 9, 9), ("q2", "b", "e9", "d1", "f1", "L1", None, None), ("q3", "a", "e1", "d1", "f1", "L2", None, None), ("q3", "b", "e4", "d1", "f1", "L1", None, None), ("q4", "a", "e5", "d1", "f1", "L7", None, None)])
_EVIDENCE = Cases("evidence_id string, document_id string, file_id string, locator string, quote string", [("e1", "d1", "f1", "L1", "a long enough quote"), ("e2", "d1", "f1", "T1", "1,000"), ("e3", "d1", "f1", "T1", "1,000"), ("e4", "d1", "f1", "L1", "not in the block"), ("e5", "d1", "f1", "L7", "somewhere else then")])
_BLOCKS = Cases("document_id string, file_id string, locator string, block_type string, text string, cells array<struct<row:int,column:int,text:string>>", [("d1", "f1", "L1", "PARAGRAPH", "here is a long enough quote indeed", None), ("d1", "f1", "T1", "TABLE", None, [{"row": 1, "column": 1, "text": "amount"}, {"row": 1, "column": 2, "text": "1,000 won"}])])


@query(expected(
    "question_id:VARCHAR slot_name:VARCHAR code:VARCHAR block_type:VARCHAR cell_text:VARCHAR excerpt:VARCHAR flags:VARCHAR",
    [
        ("q1", "a", "OK", "PARAGRAPH", None, "here is a long enough quote indeed", ""),
        ("q1", "b", "OK", "TABLE", "1,000 won", None, "NUMERIC_OR_SYMBOL_ONLY_QUOTE,SHORT_QUOTE_LE_8,DUPLICATE_QUOTE_TEXT"),
        ("q2", "a", "CELL_NOT_FOUND", "TABLE", None, None, "NUMERIC_OR_SYMBOL_ONLY_QUOTE,SHORT_QUOTE_LE_8,DUPLICATE_QUOTE_TEXT"),
        ("q2", "b", "EVIDENCE_NOT_FOUND", "PARAGRAPH", None, None, ""),
        ("q3", "a", "PROVENANCE_MISMATCH", None, None, None, ""),
        ("q3", "b", "QUOTE_NOT_FOUND", "PARAGRAPH", None, None, ""),
        ("q4", "a", "BLOCK_NOT_FOUND", None, None, None, ""),
    ],
))
def gold_link_cases(read):
    return reviews.gold_links(_LINKS(read), _EVIDENCE(read), _BLOCKS(read)).select("question_id", "slot_name", "code", "block_type", "cell_text", "excerpt", F.array_join("flags", ",").alias("flags"))


_CANDIDATES = Cases("source_id string, target_id string, score double, status string", [("s1", "t1", 0.9, "HIGH_CONFIDENCE_REVIEW"), ("s2", "t2", 0.8, "HIGH_CONFIDENCE_REVIEW"), ("s3", "t1", 0.8, "HIGH_CONFIDENCE_REVIEW"), ("s1", "t9", 0.7, "HIGH_CONFIDENCE_REVIEW"), ("s1", "t2", 0.2, "MANUAL_REVIEW")])
_DOCUMENTS = Cases("document_id string, is_correction boolean", [("s1", False), ("s2", False), ("s3", False), ("t1", False), ("t2", True)])
_QUOTES = Cases("document_id string, evidence_id string, quote string", [("s1", "e2", "계약 해지"), ("s1", "e1", "해지 금액"), ("s1", "e3", "금액"), ("s2", "e4", "해지일"), ("s3", "e5", "금액")])


@query(f"""
    WITH c AS (SELECT * FROM {_CANDIDATES}), d AS (SELECT * FROM {_DOCUMENTS}), q AS (SELECT * FROM {_QUOTES}),
    e AS (SELECT document_id, string_agg(evidence_id, ',' ORDER BY evidence_id) AS evidence FROM q WHERE contains(quote, '해지') GROUP BY document_id)
    SELECT source_id, target_id, coalesce(evidence, '') AS evidence, CASE WHEN t.is_correction THEN 'rel_2' END AS amends_id, CASE WHEN t.is_correction THEN 'BLOCKED_UNTIL_TARGET_AMENDS_CHAIN_CLOSURE' ELSE 'READY_FOR_HUMAN_REVIEW' END AS machine_status,
           CASE WHEN t.document_id IS NULL THEN 'MISSING_DOCUMENT' WHEN evidence IS NULL THEN 'NO_EXPLICIT_EVIDENCE' END AS problem
    FROM c LEFT JOIN d t ON t.document_id = target_id LEFT JOIN e ON e.document_id = source_id WHERE status = 'HIGH_CONFIDENCE_REVIEW'
""")
def termination_packets(read):
    amends = read("region").sparkSession.createDataFrame([("t2", "rel_2"), ("t1", "rel_1")], "source_id string, relation_id string")
    out = reviews.termination_packets(_CANDIDATES(read), _DOCUMENTS(read), _QUOTES(read), amends)
    return out.select("source_id", "target_id", F.array_join("evidence", ",").alias("evidence"), "amends_id", "machine_status", "problem")


_FACTS = Cases(
    "document_id string, metric_code string, value_status string, value string",
    [
        ("s", "CONTRACT_NAME", "DISCLOSED", "ABC Co. (설비)"), ("s", "CONTRACT_AMOUNT", "DISCLOSED", "10"), ("s", "CONTRACT_COUNTERPARTY", "WITHHELD", "y"), ("s", "CONTRACT_START_DATE", "DISCLOSED", "2024-01-02"),
        ("t", "CONTRACT_NAME", "DISCLOSED", "ＡＢＣ co 설비"), ("t", "CONTRACT_AMOUNT", "DISCLOSED", "10.0"), ("t", "CONTRACT_COUNTERPARTY", "DISCLOSED", "y"), ("t", "CONTRACT_START_DATE", "DISCLOSED", "2024-01-03"), ("t", "CONTRACT_END_DATE", "DISCLOSED", None),
        ("u", "CONTRACT_AMOUNT", "DISCLOSED", "11"),
    ],
)


@query("SELECT * FROM (VALUES ('s', 't', TRUE, TRUE, NULL, FALSE, NULL, 0.55::DOUBLE, 3, 2, 1), ('s', 'u', NULL, FALSE, NULL, NULL, NULL, 0.0::DOUBLE, 1, 0, 1), ('s', 'v', NULL, NULL, NULL, NULL, NULL, 0.0::DOUBLE, 0, 0, 0)) AS t(source_id, target_id, name, amount, party, first, last, score, n_compared, n_matches, n_contradictions)")
def field_match_cases(read):
    pairs = read("region").sparkSession.createDataFrame([("s", "t"), ("s", "u"), ("s", "v")], "source_id string, target_id string")
    names = {"name": "CONTRACT_NAME", "amount": "CONTRACT_AMOUNT", "party": "CONTRACT_COUNTERPARTY", "first": "CONTRACT_START_DATE", "last": "CONTRACT_END_DATE"}
    return reviews.field_matches(pairs, _FACTS(read)).select("source_id", "target_id", *(F.col("matches")[m].alias(n) for n, m in names.items()), "score", "n_compared", "n_matches", "n_contradictions")


_QUEUE = Cases("question_id string, anchors array<string>, tags array<string>, dependencies array<string>", [("q1", ["d2", "d1", "d3"], ["x"], []), ("q2", ["d4"], [], ["y"]), ("q3", [], [], [])])
_PARSED = Cases("document_id string, state string", [("d1", "PARSE_FAILED"), ("d2", "PARSE_FAILED"), ("d3", "PRESENT"), ("d4", "PRESENT")])


@query(f"""
    WITH f AS (SELECT list(document_id) AS failed FROM {_PARSED} WHERE state = 'PARSE_FAILED'), q AS (SELECT *, list_filter(anchors, lambda x: list_contains(failed, x)) AS hit FROM (SELECT * FROM {_QUEUE}), f)
    SELECT question_id, array_to_string(hit, ',') AS blocked, array_to_string(CASE WHEN len(hit) > 0 THEN list_append(tags, 'parse_blocked') ELSE tags END, ',') AS tags,
           array_to_string(CASE WHEN len(hit) > 0 THEN list_append(dependencies, 'PDF_PARSER_OR_MANUAL_PDF_REVIEW') ELSE dependencies END, ',') AS dependencies, CASE WHEN len(hit) > 0 THEN 'PARSE_BLOCKED' ELSE 'OPEN' END AS status FROM q
""")
def parse_blocked_cases(read):
    out = reviews.parse_blocked(_QUEUE(read), _PARSED(read))
    return out.select("question_id", *(F.array_join(c, ",").alias(c) for c in ("blocked", "tags", "dependencies")), "status")


_FIRST = Cases("review_id int, decision string", [(1, "ACCEPT"), (2, "REJECT"), (3, "ACCEPT")])
_SECOND = Cases("review_id int, decision string", [(1, "ACCEPT"), (2, "ACCEPT"), (4, "REJECT")])


@query(f"SELECT review_id, a.decision AS first, b.decision AS second, CASE WHEN a.decision IS NULL THEN 'NO_FIRST_REVIEW' WHEN b.decision IS NULL THEN 'NO_SECOND_REVIEW' WHEN a.decision = b.decision THEN 'AGREED' ELSE 'DISAGREED' END AS code FROM (SELECT * FROM {_FIRST}) a FULL JOIN (SELECT * FROM {_SECOND}) b USING (review_id)")
def second_review_cases(read):
    return reviews.second_reviews(_FIRST(read), _SECOND(read))


_MARKUP = Cases("id int, raw string", [(1, '<html><HEAD lang="x"><title>a</title></head></html>'), (2, "<p>no head & $1</p>"), (3, "")])


@query(f"""
    SELECT id, CASE WHEN regexp_matches(raw, '(?i)<head') THEN regexp_replace(raw, '(?i)(<head[^>]*>)', '\\1<meta charset="utf-8">') ELSE '<meta charset="utf-8">' || raw END AS page,
           '<pre>' || replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</pre>' AS source FROM {_MARKUP}
""")
def markup_views(read):
    return _MARKUP(read).select("id", markup.with_head(F.col("raw"), '<meta charset="utf-8">').alias("page"), markup.source_view(F.col("raw")).alias("source"))


_NUL = "chr(0)"


@query(f"""
    SELECT c_custkey, 'eval_usage_' || substr(sha256('a' || {_NUL} || CAST(c_custkey AS VARCHAR) || {_NUL} || 't'), 1, 24) AS usage_id, 'relation_candidate_' || substr(sha256(CAST(c_custkey AS VARCHAR) || {_NUL} || 'AMENDS'), 1, 24) AS relation_id,
           CASE WHEN c_custkey >= 1000 THEN 'event_' || substr(sha256(lpad(CAST(c_custkey AS VARCHAR), 8, '0') || {_NUL} || 'x' || {_NUL} || 'y'), 1, 24) END AS event_id FROM customer
""")
def ids_of_kinds(read):
    key = F.col("c_custkey").cast("string")
    corp = F.when(F.col("c_custkey") >= 1000, F.lpad(key, 8, "0")).otherwise(key)
    return read("customer").select(
        "c_custkey",
        ids.id_of("usage", assignment_id=F.lit("a"), run_id=key, used_at=F.lit("t")).alias("usage_id"),
        ids.id_of("relation", source_document_id=key, relation_type=F.lit("AMENDS")).alias("relation_id"),
        ids.id_of("event", corp_code=corp, event_type=F.lit("x"), chain_id=F.lit("y")).alias("event_id"),
    )


_NODE = "struct<kind:string,node_id:string,title_text:string,text:string,section_hierarchy:array<string>,normalized_rows:array<array<string>>,source:struct<rel_path:string>>"


def _node(kind: str, name: str, words: str | None = None, path: tuple = ("I",), cells: list | None = None) -> dict:
    return {"kind": kind, "node_id": name, "title_text": words if kind == "section" else None, "text": None if kind == "section" else words, "section_hierarchy": list(path), "normalized_rows": cells, "source": {"rel_path": "main.xml"}}


_FILINGS = Cases(
    f"document_id string, doc_group string, tier string, nodes array<{_NODE}>, corp_name string, report_name string",
    [
        ("d1", "periodic", "structured", [_node("section", "n1", "I. 개요"), _node("paragraph", "n2", "매출 1,000원"), _node("table", "n3", cells=[["구분", "금액"], ["매출", "10"]]), _node("table", "n4", cells=[["(단위 : 백만원)"]])], "가나", "보고서"),
        ("d2", "exchange", "structured", [_node("paragraph", "m1", "one", ("A",)), _node("paragraph", "m2", "two", ("B",)), _node("paragraph", "m3", "three", ("A",))], None, None),
        ("d3", "periodic", "fallback", [_node("paragraph", "k1", "some text"), _node("paragraph", "k2", "more")], None, None),
        ("d4", "periodic", "structured", [], None, None),
    ],
)
_CHUNK = "strategy:VARCHAR document_id:VARCHAR chunk_index:INTEGER chunk_type:VARCHAR index_role:VARCHAR raw_text:VARCHAR n_tokens:INTEGER parent_index:INTEGER path:VARCHAR nodes:VARCHAR retrieval_eligible:BOOLEAN embed_text:VARCHAR"


def _want() -> list[tuple]:
    def row(strategy, doc, k, kind, role, raw, n, parent, path, nodes, found):
        known = doc == "d1"
        head = ["기업: 가나", "문서: 보고서"] if known else []
        return (strategy, doc, k, kind, role, raw, n, parent, path, nodes, found, "\n".join([*head, f"청크유형: {kind}", *([f"섹션: {path}"] if path else [])]) + "\n\n" + raw)

    flat, sections, tree = (c["strategy"] for c in (chunking.FIXED, chunking.SECTIONS, chunking.TREE))
    whole = "I. 개요\n매출 1,000원\n구분 | 금액\n매출 | 10\n(단위 : 백만원)"
    out = [row(s, "d3", 0, "DOCUMENT_FALLBACK", "AUDIT_ONLY", "some text\nmore", 3, None, "I", "k1,k2", False) for s in (flat, sections, tree)]
    out += [row(s, "d1", 0, k, "RETRIEVAL", whole, 18, None, "I", "n1,n2,n3,n3,n4", True) for s, k in ((flat, "FIXED_WINDOW"), (sections, "SECTION_FLAT"))]
    out += [row(flat, "d2", 0, "FIXED_WINDOW", "RETRIEVAL", "one\ntwo\nthree", 3, None, "", "m1,m2,m3", True)]
    out += [row(sections, "d2", 0, "SECTION_FLAT", "RETRIEVAL", "one\nthree", 2, None, "A", "m1,m3", True), row(sections, "d2", 1, "SECTION_FLAT", "RETRIEVAL", "two", 1, None, "B", "m2", True)]
    out += [
        row(tree, "d1", 0, "SECTION_PARENT", "CONTEXT_ONLY", "I. 개요\n매출 1,000원", 7, None, "I", "n1,n2", False),
        row(tree, "d1", 1, "PARAGRAPH_CHILD", "RETRIEVAL", "매출 1,000원", 4, 0, "I", "n2", True),
        row(tree, "d1", 2, "TABLE_WHOLE", "CONTEXT_ONLY", "구분 | 금액\n매출 | 10", 6, 0, "I", "n3,n3", False),
        row(tree, "d1", 3, "TABLE_ROW", "RETRIEVAL", "구분 | 금액\n매출 | 10", 6, 2, "I", "n3,n3", True),
        row(tree, "d1", 4, "TABLE_WHOLE", "CONTEXT_ONLY", "(단위 : 백만원)", 5, 0, "I", "n4", False),
        row(tree, "d1", 5, "TABLE_ROW", "CONTEXT_ONLY", "(단위 : 백만원)", 5, 4, "I", "n4", False),
        row(tree, "d2", 0, "EVENT_PARENT", "CONTEXT_ONLY", "one\ntwo\nthree", 3, None, "", "m1,m2,m3", False),
        row(tree, "d2", 1, "FIELD_GROUP_CHILD", "RETRIEVAL", "one\nthree", 2, 0, "A", "m1,m3", True),
        row(tree, "d2", 2, "FIELD_GROUP_CHILD", "RETRIEVAL", "two", 1, 0, "B", "m2", True),
    ]
    return out


@query(expected(_CHUNK, _want()))
def chunk_cases(read):
    """Types, texts, parents, paths and spans of the chunks of four small filings, by each strategy."""
    out = None
    for config in (chunking.FIXED, chunking.SECTIONS, chunking.TREE):
        rows = chunking.chunks(_FILINGS(read), config)
        at = rows.select(F.col("chunk_id").alias("p_id"), F.col("chunk_index").alias("parent_index"))
        rows = rows.join(at, F.col("parent_chunk_id") == F.col("p_id"), "left").withColumn("strategy", F.lit(config["strategy"]))
        rows = rows.select("strategy", "document_id", "chunk_index", "chunk_type", "index_role", "raw_text", "n_tokens", "parent_index", F.array_join("section_path", " > ").alias("path"), F.array_join(F.transform("source_spans", lambda s: s["node_id"]), ",").alias("nodes"), "retrieval_eligible", "embed_text")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(expected("id:INTEGER code:VARCHAR", [(1, "OK"), (2, "RETRIEVER_INVALID_REQUEST"), (3, "RETRIEVER_SNAPSHOT_MISMATCH"), (4, "RETRIEVER_UNAVAILABLE"), (5, "RETRIEVER_INVALID_RESULT"), (6, "RETRIEVER_REQUEST_RESULT_MISMATCH"), (7, "RETRIEVER_ADAPTER_ERROR")]))
def retriever_envelope(read):
    spark = read("region").sparkSession
    pinned = {"corpus_snapshot_id": "s", "chunking_config_id": "c", "index_snapshot_id": "i"}
    ask = pinned | {"query_id": "q", "retrieval_method": "BM25", "top_k": 2}
    found = lambda rows: lambda _: spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, score double")
    good = [("q", "a", 1, 0.9), ("q", "b", 2, 0.5)]

    def broken(_):
        raise OSError("no index")

    asked = [(1, ask, found(good)), (2, ask | {"top_k": 101}, found(good)), (3, ask | {"index_snapshot_id": "j"}, found(good)), (4, ask, None), (5, ask, found([("q", "a", 1, 0.5), ("q", "b", 2, 0.9)])), (6, ask, found([("r", "a", 1, 0.9)])), (7, ask, broken)]
    return spark.createDataFrame([(k, retrieval.retrieve(request, pinned, search)[0]) for k, request, search in asked], "id int, code string")


@query(expected("rule:VARCHAR key:VARCHAR", [("FACT_ID_NOT_NULL", ""), ("DISCLOSED_VALUE", "f2"), ("WITHHELD_UNTIL", "f3"), ("RAW_VALUE", "f4"), ("FACT_ID_UNIQUE", "f1"), ("SOURCE_DOCUMENT_ID_EXISTS", "f4")]))
def schema_problems(read):
    """A table of facts against its schema: null and repeated keys, CHECK rules, references."""
    spark = read("region").sparkSession
    rows = [("f1", "DISCLOSED", "10", 10, None, "d1"), ("f1", "DISCLOSED", "10", 10, None, "d1"), ("f2", "DISCLOSED", "x", None, None, "d1"), ("f3", "MISSING", "-", None, "2030-01-01", "d1"), ("f4", "MISSING", " ", None, None, "d9"), (None, "MISSING", "-", None, None, "d1")]
    given = spark.createDataFrame(rows, "fact_id string, value_status string, raw_value_text string, numeric_value int, withheld_until string, source_document_id string").withColumn("value_type", F.lit("NUMERIC"))
    fixed = {"scale": "1", "known_at": "2024-01-01 00:00:00"}
    whole = given.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in given.columns else F.lit(None if f.nullable else fixed.get(f.name, "x")).cast(f.dataType).alias(f.name) for f in schemas.schema("facts")))
    documents = spark.createDataFrame([("d1",)], "document_id string")
    return schemas.problems(whole, "facts", {"documents": documents}).select("rule", "key")
