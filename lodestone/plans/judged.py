"""Queries that judge: scores, citations, reviews and rules of records, over whole given tables.

Orders stand in for questions, answers and filings, documents for parsed texts, pages for raw files. A table that both
dialects need is given once, as expressions that both read (Derived).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import ids, markup, text, values
from lodestone.operators import constraints, evaluation, retrieval, reviews
from lodestone.plans.queries import query
from lodestone.sources import schemas


class Derived:
    """Columns over a given table: a DataFrame, and a table expression in SQL. ``array(...)`` is a list in both."""

    def __init__(self, table: str, where: str = "true", **columns: str) -> None:
        self.table, self.where, self.columns = table, where, columns

    def __call__(self, read) -> DataFrame:
        return read(self.table).filter(self.where).selectExpr(*(f"{e} AS {c}" for c, e in self.columns.items()))

    def __str__(self) -> str:
        return "(SELECT " + ", ".join(f"{e.replace('array(', 'list_value(')} AS {c}" for c, e in self.columns.items()) + f" FROM {self.table} WHERE {self.where})"


_ANSWERS = Derived(
    "orders",
    id="o_orderkey",
    kind="CASE o_orderkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'flag' ELSE 'words' END",
    comparator="CASE o_custkey % 5 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'ABSOLUTE' WHEN 2 THEN 'RELATIVE' WHEN 3 THEN 'PERCENTAGE_POINT' ELSE 'RANGE' END",
    number="CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice) AS DOUBLE) END",
    tolerance="CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(0.5 AS DOUBLE) WHEN 2 THEN CAST(0.02 AS DOUBLE) ELSE CAST(2000 AS DOUBLE) END",
    low="CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice) - 500 AS DOUBLE) END",
    high="CAST(floor(o_totalprice) + 500 AS DOUBLE)",
    flag="o_orderstatus = 'F'",
    words="o_orderpriority",
    result="CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) + o_custkey % 9 * 200 - 200 AS STRING) WHEN o_orderkey % 3 = 1 THEN CASE o_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'maybe' END ELSE CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) END END",
    value="CASE WHEN o_orderkey % 21 = 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END",
    answer="CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN concat('it is ', o_orderpriority, ' indeed') ELSE 'no idea' END",
)


@query(f"""
    WITH c AS (SELECT *, TRY_CAST(CASE WHEN result IS NOT NULL THEN result ELSE value END AS DOUBLE) AS n, coalesce(result, value) AS s FROM {_ANSWERS})
    SELECT id, CASE
        WHEN kind = 'number' AND comparator = 'RANGE' THEN CASE WHEN low IS NULL OR high IS NULL OR n IS NULL THEN 'NOT_SCORED' WHEN n >= low AND n <= high THEN 'PASS' ELSE 'FAIL' END
        WHEN kind = 'number' THEN CASE WHEN number IS NULL OR n IS NULL THEN 'NOT_SCORED' WHEN abs(n - number) <= coalesce(tolerance, 0) * (CASE WHEN comparator = 'RELATIVE' THEN abs(number) ELSE 1 END) THEN 'PASS' ELSE 'FAIL' END
        WHEN kind = 'flag' THEN CASE WHEN s IS NULL OR s NOT IN ('true', 'false') THEN 'NOT_SCORED' WHEN (s = 'true') = flag THEN 'PASS' ELSE 'FAIL' END
        ELSE CASE WHEN s IS NOT NULL THEN (CASE WHEN s = words THEN 'PASS' ELSE 'FAIL' END) WHEN answer IS NOT NULL THEN (CASE WHEN contains(answer, words) THEN 'PASS' ELSE 'FAIL' END) ELSE 'NOT_SCORED' END END AS status
    FROM c
""")
def closed_scoring_cases(read):
    """An order as a closed question: numbers by every comparator, truth values, texts."""
    n, stated = evaluation.structured_number(F.col("result"), F.col("value")), F.coalesce("result", "value")
    number = evaluation.numeric_match(F.col("comparator"), F.col("number"), n, F.col("tolerance"), F.col("low"), F.col("high"))
    flag = evaluation.boolean_match(F.col("flag"), F.when(stated == "true", True).when(stated == "false", False))
    status = F.when(F.col("kind") == "number", number).when(F.col("kind") == "flag", flag).otherwise(evaluation.text_match(F.col("words"), stated, F.col("answer")))
    return _ANSWERS(read).select("id", status.alias("status"))


#: A slot of a question is an order of a customer; its source is the order's day and number.
_SLOT = {"question_id": "o_custkey", "slot_id": "CAST(o_orderkey AS STRING)", "document_id": "concat('d', o_orderkey % 500)", "locator": "concat('L', o_orderkey % 7)", "quote": "concat('quote ', o_orderkey)"}
_SLOTS = Derived("orders", **_SLOT, empty="o_orderkey % 19 = 0")
_CONTEXTS = Derived(
    "orders",
    where="o_orderkey % 11 <> 0",
    question_id="o_custkey",
    evidence_id="CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'e_unknown' ELSE concat('e', o_orderkey) END",
    document_id="CASE o_orderkey % 6 WHEN 0 THEN 'd_other' WHEN 1 THEN NULL ELSE concat('d', o_orderkey % 500) END",
    locator="CASE o_orderkey % 8 WHEN 0 THEN 'L_other' WHEN 1 THEN NULL ELSE concat('L', o_orderkey % 7) END",
    quote="CASE o_orderkey % 9 WHEN 0 THEN 'another' ELSE concat('quote ', o_orderkey) END",
)
_PROVEN = Derived("orders", where="o_orderpriority <> '5-LOW'", **(_SLOT | {"evidence_id": "concat('e', o_orderkey)"}))
_GROUNDED = f"""
    SELECT question_id, slot_id, NOT empty AND (
        EXISTS (SELECT 1 FROM {_CONTEXTS} c JOIN {_PROVEN} v ON v.question_id = c.question_id AND v.evidence_id = c.evidence_id WHERE c.question_id = s.question_id AND v.slot_id = s.slot_id AND coalesce(c.document_id = v.document_id, TRUE) AND coalesce(c.locator = v.locator, TRUE) AND coalesce(c.quote = v.quote, TRUE))
        OR EXISTS (SELECT 1 FROM {_CONTEXTS} c WHERE c.question_id = s.question_id AND coalesce(c.evidence_id, '') = '' AND c.document_id = s.document_id AND c.locator = s.locator AND c.quote = s.quote)) AS grounded
    FROM {_SLOTS} s
"""


@query(_GROUNDED)
def slot_groundedness(read):
    """The orders of a customer as evidence slots of one question, against what its answer cites."""
    source = F.struct("document_id", "locator", "quote")
    slots = _SLOTS(read).select("question_id", "slot_id", F.when(F.col("empty"), F.array().cast("array<struct<document_id:string,locator:string,quote:string>>")).otherwise(F.array(source)).alias("sources"))
    return evaluation.groundedness(slots, _CONTEXTS(read), _PROVEN(read).withColumn("quote_sha256", F.sha2("quote", 256)))


_OPEN = Derived(
    "orders",
    question_id="o_orderkey",
    name="CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END",
    day="CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    short="o_orderstatus",
    answer="CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE concat(CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE 'nothing' END, ' on ', CASE WHEN o_custkey % 3 = 0 THEN '1990-01-01' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END) END",
    cited="CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'd_other' ELSE concat('d', o_orderkey) END",
    evidence="CASE o_orderkey % 9 WHEN 0 THEN 'e_other' WHEN 1 THEN NULL ELSE concat('e', o_orderkey) END",
)


@query(f"""
    WITH g AS (SELECT CAST(slot_id AS BIGINT) AS question_id, grounded FROM ({_GROUNDED}))
    SELECT question_id, CASE WHEN grounded THEN 'PASS' ELSE 'FAIL' END AS required_evidence_coverage,
           CASE WHEN name IS NULL THEN 'NOT_SCORED' WHEN contains(coalesce(answer, ''), name) THEN 'PASS' ELSE 'FAIL' END AS explicit_fact_value_slots,
           CASE WHEN day IS NULL THEN 'NOT_SCORED' WHEN contains(coalesce(answer, ''), day) THEN 'PASS' ELSE 'FAIL' END AS temporal_requirements,
           'NOT_SCORED' AS requested_format, 'REVIEW_REQUIRED' AS claim_coverage,
           CASE WHEN cited IS NULL THEN 'NOT_SCORED' WHEN cited = 'd_other' OR evidence = 'e_other' THEN 'FAIL' ELSE 'PASS' END AS groundedness
    FROM {_OPEN} JOIN g USING (question_id)
""")
def answers_scored(read):
    """Orders as open questions with recorded answers."""
    rows, key = _OPEN(read), F.col("question_id").cast("string")
    gold = rows.select("question_id", F.create_map(F.lit("name"), "name", F.lit("day"), "day", F.lit("short"), "short").alias("fields"), F.array(F.concat(F.lit("d"), key)).alias("documents"), F.array(F.concat(F.lit("e"), key)).alias("evidence_ids"))
    said = rows.select("question_id", "answer", F.array(F.struct(F.col("cited").alias("document_id"), F.col("evidence").alias("evidence_id"))).alias("contexts"))
    grounded = slot_groundedness(read).select(F.col("slot_id").cast("long").alias("question_id"), "slot_id", "grounded")
    return evaluation.open_scores(gold, said, grounded)


@query("""
    SELECT 'e' || doc_id AS evidence_id, CASE doc_id % 13
        WHEN 0 THEN 'EVIDENCE_NOT_FOUND' WHEN 1 THEN 'EVIDENCE_SNAPSHOT_MISMATCH' WHEN 2 THEN 'EVIDENCE_DOCUMENT_MISMATCH' WHEN 3 THEN 'EVIDENCE_LOCATOR_MISMATCH' WHEN 4 THEN 'EVIDENCE_QUOTE_MISMATCH' WHEN 5 THEN 'EVIDENCE_HASH_MISMATCH'
        WHEN 6 THEN 'UNVERIFIED_DATA_FORBIDDEN' WHEN 7 THEN 'DOCUMENT_NOT_FOUND' WHEN 8 THEN 'SNAPSHOT_MISMATCH' WHEN 9 THEN 'LOCATOR_NOT_FOUND'
        ELSE CASE WHEN substr(text, 11, 40) <> '' AND contains(CASE WHEN doc_id % 13 = 10 THEN upper(text) ELSE text END, substr(text, 11, 40)) THEN 'OK' ELSE 'QUOTE_MISMATCH' END END AS code
    FROM documents
""")
def citation_check(read):
    """Citations of every document against stores of evidence and of blocks, which differ from them in each way."""
    part = F.col("doc_id") % 13
    docs = read("documents").withColumn("part", part)
    key = F.col("doc_id").cast("string")
    cited = docs.select("part", F.concat(F.lit("e"), key).alias("evidence_id"), F.concat(F.lit("d"), key).alias("document_id"), F.concat(F.lit("f"), key).alias("file_id"), F.lit("L1").alias("locator"), F.substring("text", 11, 40).alias("quote"), "text")
    cited = cited.withColumn("quote_sha256", F.when(part_is(5), "00").otherwise(F.sha2("quote", 256)))
    kept = cited.filter(~part_is(0)).withColumn("corpus_snapshot_id", F.when(part_is(1), "s0").otherwise("s1")).withColumn("document_id", F.when(part_is(2), "d").otherwise(F.col("document_id")))
    kept = kept.withColumn("locator", F.when(part_is(3), "L9").otherwise(F.col("locator"))).withColumn("quote", F.when(part_is(4), F.concat("quote", F.lit("!"))).otherwise(F.col("quote"))).withColumn("quote_sha256", F.sha2("quote", 256))
    kept = kept.withColumn("verification_status", F.when(part_is(6), "CANDIDATE").otherwise("VERIFIED"))
    blocks = cited.filter(~part_is(7)).withColumn("corpus_snapshot_id", F.when(part_is(8), "s0").otherwise("s1")).withColumn("locator", F.when(part_is(9), "L2").otherwise(F.col("locator"))).withColumn("text", F.when(part_is(10), F.upper("text")).otherwise(F.col("text")))
    return evaluation.citation_codes(cited.drop("part", "text"), kept.drop("part", "text"), blocks, "s1")


def part_is(k: int):
    return F.col("part") == k


_QUESTIONS = Derived("orders", question_id="concat('q', o_orderkey)", evaluation_group_id="concat('g', o_custkey)", split="CASE WHEN o_orderpriority = '1-URGENT' THEN 'HOLDOUT' WHEN o_orderpriority = '2-HIGH' THEN 'DEV_CHECK' ELSE 'DEV_TUNE' END")
_OWN_LOCKS = Derived("orders", where="o_orderstatus = 'F'", assignment_id="concat('q', o_orderkey)", lock_status="CASE WHEN o_totalprice > 200000 THEN 'LOCKED_BY_CHAIN' ELSE 'PROVISIONAL_UNTIL_CHAIN_CLOSURE' END")
_GROUP_LOCKS = Derived("customer", where="c_acctbal > 0", assignment_id="concat('g', c_custkey)", lock_status="CASE WHEN c_mktsegment = 'BUILDING' THEN 'PROVISIONAL_UNTIL_CHAIN_CLOSURE' ELSE 'LOCKED_BY_COVERAGE' END")


@query(f"""
    WITH q AS (SELECT * FROM {_QUESTIONS}), s AS (SELECT q.*, coalesce(o.lock_status, g.lock_status) AS k FROM q LEFT JOIN {_OWN_LOCKS} o ON o.assignment_id = question_id LEFT JOIN {_GROUP_LOCKS} g ON g.assignment_id = evaluation_group_id)
    SELECT 'SANDBOX' AS run, question_id FROM s WHERE k LIKE 'PROVISIONAL%' UNION ALL SELECT 'NARROWED', question_id FROM s WHERE k LIKE 'PROVISIONAL%' AND question_id IN ('q1', 'q2', 'q3', 'q4', 'q5') UNION ALL SELECT 'HOLDOUT', question_id FROM s WHERE split = 'HOLDOUT'
""")
def split_eligibility(read):
    """The questions that a run may use, by their own lock or their group's."""
    q, life = _QUESTIONS(read), _OWN_LOCKS(read).unionByName(_GROUP_LOCKS(read))
    runs = {"SANDBOX": evaluation.eligible(q, "SANDBOX", life), "NARROWED": evaluation.eligible(q, "SANDBOX", life, [f"q{k}" for k in range(1, 6)]), "HOLDOUT": evaluation.eligible(q, "HOLDOUT")}
    out = None
    for name, rows in runs.items():
        rows = rows.select(F.lit(name).alias("run"), "question_id")
        out = rows if out is None else out.unionByName(rows)
    return out


_RAW = Derived(
    "lineitem",
    id="concat(l_orderkey, '/', l_partkey, '/', l_suppkey, '/', l_linenumber)",
    metric="CASE l_linenumber % 4 WHEN 0 THEN 'CONTRACT_AMOUNT' WHEN 1 THEN 'CONTRACT_START_DATE' WHEN 2 THEN 'CONTRACT_COUNTERPARTY' ELSE 'WITHHELD_UNTIL' END",
    kind="CASE l_linenumber % 4 WHEN 0 THEN 'NUMERIC' WHEN 2 THEN 'TEXT' ELSE 'DATE' END",
    raw="CASE l_partkey % 6 WHEN 0 THEN '-' WHEN 1 THEN '해당사항 없음' WHEN 2 THEN 'odd' ELSE concat(CASE l_linenumber % 4 WHEN 0 THEN concat(CAST(CAST(floor(l_extendedprice) AS BIGINT) // 1000 AS STRING), ',', lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 3, '0')) WHEN 2 THEN concat('공급 ', l_suppkey) ELSE replace(CAST(CAST(l_shipdate AS DATE) AS STRING), '-', '.') END, CASE WHEN l_returnflag = 'R' THEN '(예정)' ELSE '' END) END",
    withheld="l_linestatus = 'F'",
    plain="CAST(floor(l_extendedprice) AS BIGINT)",
    day="CAST(l_shipdate AS DATE)",
    supplier="l_suppkey",
    open="l_partkey % 6 > 2",
    odd="l_partkey % 6 = 2",
    dash="l_partkey % 6 = 0",
    planned="l_partkey % 6 > 2 AND l_returnflag = 'R'",
)


@query(f"""
    WITH c AS (SELECT *, CASE WHEN open OR odd AND kind = 'TEXT' THEN 'DISCLOSED' WHEN dash AND withheld AND metric NOT LIKE 'WITHHELD%' THEN 'WITHHELD' WHEN dash OR odd THEN 'MISSING' ELSE 'NOT_APPLICABLE' END AS status FROM {_RAW})
    SELECT id, status, CASE WHEN status <> 'DISCLOSED' THEN 'NOT_RELEVANT' WHEN planned THEN 'PLANNED' ELSE 'CONFIRMED' END AS certainty,
           CASE WHEN kind = 'NUMERIC' AND open THEN CAST(plain AS DOUBLE) END AS numeric_value, CASE WHEN kind = 'DATE' AND open THEN CAST(day AS VARCHAR) END AS date_value,
           CASE WHEN kind = 'TEXT' AND open THEN '공급 ' || supplier WHEN kind = 'TEXT' AND odd THEN 'odd' END AS text_value
    FROM c
""")
def value_cases(read):
    """Cells as disclosed, planned, withheld, missing and not applicable values of three kinds."""
    expressions = {c: e.replace("//", "DIV") for c, e in _RAW.columns.items()}
    rows = read("lineitem").selectExpr(*(f"{e} AS {c}" for c, e in expressions.items()))
    rows = rows.withColumn("v", values.value_status(F.col("raw"), F.col("kind"), F.col("metric"), F.col("withheld")))
    return rows.select("id", "v.status", "v.certainty", F.col("v.numeric_value").cast("double").alias("numeric_value"), F.col("v.date_value").cast("string").alias("date_value"), "v.text_value")


_DAYS = Derived("orders", id="o_orderkey", raw="CASE o_orderkey % 6 WHEN 0 THEN concat(year(o_orderdate), '년 ', month(o_orderdate), '월 ', day(o_orderdate), '일') WHEN 1 THEN concat(year(o_orderdate), '.', month(o_orderdate), '.', day(o_orderdate)) WHEN 2 THEN concat(year(o_orderdate), '-', month(o_orderdate) + 6, '-', day(o_orderdate)) WHEN 3 THEN concat(year(o_orderdate), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/31') WHEN 4 THEN '-' ELSE concat(year(o_orderdate), month(o_orderdate)) END")


@query(rf"""
    WITH c AS (SELECT id, regexp_extract(raw, '^\s*(\d{{4}})\s*[.년/-]\s*(\d{{1,2}})\s*[.월/-]\s*(\d{{1,2}})\s*[.일]?\s*$', ['y', 'm', 'd']) AS p FROM {_DAYS})
    SELECT id, CAST(CASE WHEN p.y <> '' THEN TRY_CAST(p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE) END AS VARCHAR) AS day FROM c
""")
def date_cases(read):
    """Days in six forms, some of which are none."""
    return _DAYS(read).select("id", text.parse_date(F.col("raw")).cast("string").alias("day"))


_SETS = Derived("orders", id="o_orderkey", a="array(o_orderpriority, o_orderstatus, CAST(o_custkey % 3 AS STRING), o_orderpriority)", b="CASE WHEN o_orderkey % 3 = 0 THEN array(CAST(o_orderkey % 3 AS STRING), o_orderstatus) WHEN o_orderkey % 3 = 1 THEN array(CAST(o_custkey % 3 AS STRING), o_orderstatus, o_orderpriority, o_orderstatus) ELSE array(o_orderstatus, o_orderpriority) END")


@query(f"SELECT id, array_to_string(list_filter(a, lambda x, i: list_contains(b, x) AND list_position(a, x) = i), ',') AS both_sides, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same FROM {_SETS}")
def set_cases(read):
    return _SETS(read).select("id", F.array_join(values.ordered_intersection(F.col("a"), F.col("b")), ",").alias("both_sides"), values.same_members(F.col("a"), F.col("b")).alias("same"))


@query("""
    WITH m AS (SELECT 'i' || o_orderkey AS k, o_orderkey % 9 AS p, o_orderstatus AS st FROM orders)
    SELECT 'SCHEMA_VERSION' AS rule, k AS key FROM m WHERE p = 1 UNION ALL SELECT 'corpus_snapshot_id_REQUIRED', k FROM m WHERE p = 2 UNION ALL SELECT 'COMPONENTS', k FROM m WHERE p = 3
    UNION ALL SELECT 'ROLES', k FROM m WHERE p = 4 UNION ALL SELECT 'ROLES_DIFFER', k FROM m WHERE p = 5 UNION ALL SELECT 'DENSE_MODEL', k FROM m WHERE p NOT IN (3, 4, 5) AND st = 'P'
    UNION ALL SELECT 'HYBRID_PARTS', k FROM m WHERE p IN (3, 4, 5)
""")
def index_manifest_rules(read):
    """Orders as manifests of indexes, some of which break a rule."""
    part = lambda role, model=None: F.struct(F.lit(role).alias("component_role"), (F.lit(None).cast("string") if model is None else model).alias("embedding_model_id"))
    p, model = F.col("o_orderkey") % 9, F.when(F.col("o_orderstatus") != "P", F.lit("m"))
    parts = F.when(p == 3, F.array(part("LEXICAL"), part("LEXICAL"))).when(p == 4, F.array(part("LEXICAL"), part("ODD"))).when(p == 5, F.array(part("LEXICAL"), part("LEXICAL"))).otherwise(F.array(part("LEXICAL"), part("DENSE", model)))
    rows = read("orders").select(
        F.when(p == 1, "0.2.0").otherwise("0.1.0").alias("schema_version"), F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("index_snapshot_id"), F.when(p != 2, "s").alias("corpus_snapshot_id"), F.lit("c").alias("chunking_config_id"),
        F.col("o_orderdate").alias("created_at"), F.when(p == 3, F.slice(parts, 1, 0)).otherwise(parts).alias("components"), F.lit("RRF").alias("hybrid_combination"),
    )
    return constraints.index_snapshot(rows).select("rule", "key")


@query("""
    WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % 8 AS p FROM orders)
    SELECT 'TOP_K_AGREES' AS rule, k AS key FROM p WHERE p = 1 UNION ALL SELECT 'QUERY_ID_AGREES', k FROM p WHERE p = 2 UNION ALL SELECT 'RETRIEVAL_METHOD_AGREES', k FROM p WHERE p = 3
    UNION ALL SELECT 'INDEX_SNAPSHOT_ID_AGREES', k FROM p WHERE p = 4 UNION ALL SELECT 'FILTERS_AGREE', k FROM p WHERE p = 5
""")
def request_result_rules(read):
    """Requests and results that must agree in every field, and in filters whatever their order."""
    p, key = F.col("o_orderkey") % 8, F.col("o_orderkey").cast("string")
    fields = {"query_id": key, "retrieval_method": F.col("o_orderpriority"), "corpus_snapshot_id": F.lit("s"), "chunking_config_id": F.lit("c"), "index_snapshot_id": F.col("o_orderstatus"), "top_k": (F.col("o_custkey") % 20).cast("int")}
    changed = fields | {"top_k": fields["top_k"] + (p == 1).cast("int"), "query_id": F.when(p == 2, F.lit("other")).otherwise(key), "retrieval_method": F.when(p == 3, F.lit(None)).otherwise(F.col("o_orderpriority")), "index_snapshot_id": F.when(p == 4, "X").otherwise(F.col("o_orderstatus"))}
    corp, group = F.array(F.col("o_custkey").cast("string")), F.array("o_orderstatus")
    asked = F.when(p == 6, F.lit(None).cast("map<string,array<string>>")).otherwise(F.create_map(F.lit("corp_code"), corp, F.lit("doc_group"), group))
    used = F.when(p == 6, F.create_map().cast("map<string,array<string>>")).when(p == 5, F.create_map(F.lit("corp_code"), corp)).otherwise(F.create_map(F.lit("doc_group"), group, F.lit("corp_code"), corp))
    side = lambda f, name, m: F.struct(*(c.alias(n) for n, c in f.items()), m.alias(name))
    return constraints.request_result_pair(read("orders").select(key.alias("pair_id"), side(fields, "metadata_filters", asked).alias("request"), side(changed, "applied_filters", used).alias("result"))).select("rule", "key")


@query("""
    WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') END AS r, month(o_orderdate) + CASE WHEN o_custkey % 5 = 0 THEN 6 ELSE 0 END AS m, o_custkey % 3 AS files FROM orders)
    SELECT 'RECEIPT' AS rule, CAST(k AS VARCHAR) AS key FROM d WHERE length(r) <> 14 UNION ALL SELECT 'BASE_MONTH', CAST(k AS VARCHAR) FROM d WHERE m > 12
    UNION ALL SELECT 'FILES', CAST(k AS VARCHAR) FROM d WHERE files = 0 UNION ALL SELECT 'DOCUMENT_ID', CAST(k AS VARCHAR) FROM d WHERE k % 11 = 0
""")
def table_checks(read):
    """Orders as filings, against the CHECK rules of their table."""
    receipt = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey").cast("string")).otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")))
    month = F.month("o_orderdate") + F.when(F.col("o_custkey") % 5 == 0, 6).otherwise(0)
    rows = read("orders").select(F.col("o_orderkey").cast("string").alias("key"), F.lit("periodic").alias("doc_group"), receipt.alias("receipt_number"), month.alias("base_month"), (F.col("o_custkey") % 3).alias("declared_file_count"))
    rows = rows.withColumn("document_id", F.concat(F.when(F.col("key").cast("long") % 11 == 0, "major").otherwise("periodic"), F.lit("_"), "receipt_number"))
    return constraints.checks(rows, "documents", "key").select("rule", "key")


@query("""
    WITH e AS (SELECT doc_id, substr(text, 21, CASE WHEN doc_id % 5 = 0 THEN 6 ELSE 60 END) AS quote, text FROM documents),
    n AS (SELECT quote, count(*) AS n FROM e WHERE doc_id % 7 <> 1 GROUP BY quote)
    SELECT e.doc_id AS question_id, CASE WHEN doc_id % 7 = 1 THEN 'EVIDENCE_NOT_FOUND' WHEN doc_id % 7 = 2 THEN 'PROVENANCE_MISMATCH' WHEN doc_id % 7 = 3 THEN 'BLOCK_NOT_FOUND' WHEN doc_id % 7 = 4 THEN 'CELL_NOT_FOUND'
             WHEN doc_id % 7 = 5 AND NOT contains(lower(text), e.quote) THEN 'QUOTE_NOT_FOUND' ELSE 'OK' END AS code,
           CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 7 IN (4, 6) THEN 'TABLE' ELSE 'PARAGRAPH' END AS block_type,
           CASE WHEN doc_id % 7 = 6 THEN text END AS cell_text,
           concat_ws(',', CASE WHEN doc_id % 7 <> 1 AND regexp_full_match(e.quote, '[\\s0-9,.$%+\\-:/()]+') THEN 'NUMERIC_OR_SYMBOL_ONLY_QUOTE' END, CASE WHEN doc_id % 7 <> 1 AND length(e.quote) <= 8 THEN 'SHORT_QUOTE_LE_8' END, CASE WHEN doc_id % 7 <> 1 AND n > 1 THEN 'DUPLICATE_QUOTE_TEXT' END) AS flags
    FROM e LEFT JOIN n ON n.quote = e.quote
""")
def gold_link_cases(read):
    """A link of every document to a quote of it: lost, misplaced, in a paragraph or in a cell."""
    part, key = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    docs = read("documents").withColumn("p", part).withColumn("quote", F.when(F.col("doc_id") % 5 == 0, F.substring("text", 21, 6)).otherwise(F.substring("text", 21, 60)))
    at = [F.concat(F.lit("e"), key).alias("evidence_id"), F.concat(F.lit("d"), key).alias("document_id"), F.lit("f").alias("file_id"), F.lit("L").alias("locator")]
    links = docs.select(F.col("doc_id").alias("question_id"), F.lit("slot").alias("slot_name"), *at, F.when(F.col("p") == 4, 9).otherwise(1).alias("row"), F.lit(1).alias("column"))
    evidence = docs.filter("p <> 1").select(*at, "quote", "p").withColumn("document_id", F.when(F.col("p") == 2, "d_other").otherwise(F.col("document_id"))).drop("p")
    cell = F.array(F.struct(F.lit(1).alias("row"), F.lit(1).alias("column"), F.col("text").alias("text")))
    blocks = docs.filter("p <> 3").select(*at[1:], F.lit("PARAGRAPH").alias("block_type"), F.when(F.col("p") == 5, F.lower("text")).otherwise(F.col("text")).alias("text"), F.when(F.col("p").isin(4, 6), cell).alias("cells"))
    return reviews.gold_links(links, evidence, blocks).select("question_id", "code", "block_type", "cell_text", F.array_join("flags", ",").alias("flags"))


_PAIRS = Derived("orders", source_id="concat('s', o_orderkey)", target_id="concat('t', o_custkey)", score="CAST(0.9 AS DOUBLE)", status="CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH_CONFIDENCE_REVIEW' ELSE 'MANUAL_REVIEW' END")
_SOURCES = Derived("orders", where="o_orderkey % 23 <> 0", document_id="concat('s', o_orderkey)", is_correction="false")
_TARGETS = Derived("customer", where="c_custkey % 17 <> 0", document_id="concat('t', c_custkey)", is_correction="c_acctbal < 0")
_QUOTED = Derived("lineitem", document_id="concat('s', l_orderkey)", evidence_id="concat('e', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey)", quote="CASE WHEN l_returnflag = 'R' THEN '계약 해지' ELSE '금액' END")
_AMENDS = Derived("customer", where="c_nationkey <> 3", source_id="concat('t', c_custkey)", relation_id="concat('rel_', c_custkey)")


@query(f"""
    WITH e AS (SELECT document_id, string_agg(evidence_id, ',' ORDER BY evidence_id) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY evidence_id) AS n FROM {_QUOTED} WHERE contains(quote, '해지')) WHERE n <= 10 GROUP BY document_id)
    SELECT c.source_id, target_id, coalesce(evidence, '') AS evidence, CASE WHEN t.is_correction THEN a.relation_id END AS amends_id, CASE WHEN t.is_correction THEN 'BLOCKED_UNTIL_TARGET_AMENDS_CHAIN_CLOSURE' ELSE 'READY_FOR_HUMAN_REVIEW' END AS machine_status,
           CASE WHEN s.document_id IS NULL OR t.document_id IS NULL THEN 'MISSING_DOCUMENT' WHEN evidence IS NULL THEN 'NO_EXPLICIT_EVIDENCE' END AS problem
    FROM {_PAIRS} c LEFT JOIN {_SOURCES} s ON s.document_id = c.source_id LEFT JOIN {_TARGETS} t ON t.document_id = target_id LEFT JOIN e ON e.document_id = c.source_id LEFT JOIN {_AMENDS} a ON a.source_id = target_id WHERE status = 'HIGH_CONFIDENCE_REVIEW'
""")
def termination_packets(read):
    """Orders as terminations of what their customers had agreed to, with line items as quotes."""
    out = reviews.termination_packets(_PAIRS(read), _SOURCES(read).unionByName(_TARGETS(read)), _QUOTED(read), _AMENDS(read))
    return out.select("source_id", "target_id", F.array_join("evidence", ",").alias("evidence"), "amends_id", "machine_status", "problem")


#: The facts of a contract by its order, as the source tells them and as the target does.
_SIDES = {
    "CONTRACT_NAME": ("concat('Contract No. ', o_custkey)", "CASE WHEN o_orderkey % 3 = 0 THEN concat('CONTRACT (no) ', o_custkey) WHEN o_orderkey % 3 = 1 THEN concat('contract no: ', o_custkey + 1) END"),
    "CONTRACT_COUNTERPARTY": ("o_orderpriority", "CASE WHEN o_orderkey % 5 = 0 THEN lower(replace(o_orderpriority, '-', ' ')) WHEN o_orderkey % 5 = 1 THEN 'another' END"),
    "CONTRACT_AMOUNT": ("CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)", "CASE WHEN o_orderkey % 7 < 3 THEN concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.0') ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) + 1 AS STRING) END"),
    "CONTRACT_END_DATE": ("CAST(CAST(o_orderdate AS DATE) AS STRING)", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END"),
}


@query(f"""
    WITH c AS (SELECT o_orderkey AS k, o_orderstatus = 'P' AS withheld, {', '.join(f'{s} AS s{i}, {t} AS t{i}' for i, (s, t) in enumerate(_SIDES.values()))} FROM orders),
    m AS (SELECT k, regexp_replace(lower(s0), '[^a-z0-9]', '', 'g') = regexp_replace(lower(t0), '[^a-z0-9]', '', 'g') AS m0, regexp_replace(lower(s1), '[^a-z0-9]', '', 'g') = regexp_replace(lower(t1), '[^a-z0-9]', '', 'g') AS m1,
                 CASE WHEN NOT withheld THEN CAST(s2 AS DOUBLE) = CAST(t2 AS DOUBLE) END AS m2, s3 = t3 AS m3 FROM c)
    SELECT k, m0 AS same_name, m1 AS same_party, m2 AS same_amount, m3 AS same_end,
           round(CASE WHEN m0 THEN 0.35 ELSE 0 END + CASE WHEN m1 THEN 0.25 ELSE 0 END + CASE WHEN m2 THEN 0.2 ELSE 0 END + CASE WHEN m3 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS score,
           CAST((m0 IS NOT NULL)::INT + (m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT + (m3 IS NOT NULL)::INT AS INTEGER) AS n_compared,
           CAST(coalesce((NOT m0)::INT, 0) + coalesce((NOT m1)::INT, 0) + coalesce((NOT m2)::INT, 0) + coalesce((NOT m3)::INT, 0) AS INTEGER) AS n_contradictions
    FROM m
""")
def field_match_cases(read):
    """Orders as pairs of contracts whose facts are told in two ways."""
    orders, facts = read("orders"), None
    for metric, sides in _SIDES.items():
        status = F.when((F.col("o_orderstatus") == "P") & F.lit(metric == "CONTRACT_AMOUNT"), "WITHHELD").otherwise("DISCLOSED")
        for name, value in zip("st", sides, strict=True):
            part = orders.select(F.concat(F.lit(name), F.col("o_orderkey").cast("string")).alias("document_id"), F.lit(metric).alias("metric_code"), status.alias("value_status"), F.expr(value).alias("value"))
            facts = part if facts is None else facts.unionByName(part)
    key = F.col("o_orderkey").cast("string")
    pairs = orders.select(F.concat(F.lit("s"), key).alias("source_id"), F.concat(F.lit("t"), key).alias("target_id"))
    m = F.col("matches")
    found = reviews.field_matches(pairs, facts)
    return found.select(F.substring("source_id", 2, 20).cast("long").alias("k"), m["CONTRACT_NAME"].alias("same_name"), m["CONTRACT_COUNTERPARTY"].alias("same_party"), m["CONTRACT_AMOUNT"].alias("same_amount"), m["CONTRACT_END_DATE"].alias("same_end"), "score", "n_compared", "n_contradictions")


_QUEUE = Derived("orders", question_id="o_orderkey", anchors="array(concat('d', o_custkey), concat('d', o_custkey % 40), concat('d', o_orderkey % 300))", tags="array(o_orderstatus)", dependencies="array(o_orderpriority)")
_PARSED = Derived("customer", document_id="concat('d', c_custkey)", state="CASE WHEN c_acctbal < 0 THEN 'PARSE_FAILED' ELSE 'PRESENT' END")


@query(f"""
    WITH q AS (SELECT * FROM {_QUEUE}), a AS (SELECT question_id, unnest(anchors) AS d, generate_subscripts(anchors, 1) AS i FROM q),
    h AS (SELECT question_id, string_agg(d, ',' ORDER BY i) AS blocked FROM a JOIN {_PARSED} ON document_id = d AND state = 'PARSE_FAILED' GROUP BY question_id)
    SELECT question_id, coalesce(blocked, '') AS blocked, tags[1] || CASE WHEN blocked IS NULL THEN '' ELSE ',parse_blocked' END AS tags, dependencies[1] || CASE WHEN blocked IS NULL THEN '' ELSE ',PDF_PARSER_OR_MANUAL_PDF_REVIEW' END AS dependencies,
           CASE WHEN blocked IS NULL THEN 'OPEN' ELSE 'PARSE_BLOCKED' END AS status
    FROM q LEFT JOIN h USING (question_id)
""")
def parse_blocked_cases(read):
    """Orders as questions, customers as filings whose parse may have failed."""
    out = reviews.parse_blocked(_QUEUE(read), _PARSED(read))
    return out.select("question_id", *(F.array_join(c, ",").alias(c) for c in ("blocked", "tags", "dependencies")), "status")


_FIRST = Derived("orders", where="o_orderstatus <> 'P'", review_id="o_orderkey", decision="CASE WHEN o_totalprice > 100000 THEN 'ACCEPT' ELSE 'REJECT' END")
_SECOND = Derived("orders", where="o_orderpriority <> '5-LOW'", review_id="o_orderkey", decision="CASE WHEN o_totalprice > 120000 THEN 'ACCEPT' ELSE 'REJECT' END")


@query(f"SELECT review_id, a.decision AS first, b.decision AS second, CASE WHEN a.decision IS NULL THEN 'NO_FIRST_REVIEW' WHEN b.decision IS NULL THEN 'NO_SECOND_REVIEW' WHEN a.decision = b.decision THEN 'AGREED' ELSE 'DISAGREED' END AS code FROM {_FIRST} a FULL JOIN {_SECOND} b USING (review_id)")
def second_review_cases(read):
    return reviews.second_reviews(_FIRST(read), _SECOND(read))


@query("""
    SELECT page_id, sha256(CASE WHEN regexp_matches(html, '(?i)<head') THEN regexp_replace(html, '(?i)(<head[^>]*>)', '\\1<meta charset="utf-8">') ELSE '<meta charset="utf-8">' || html END) AS page_sha256,
           sha256('<pre>' || replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</pre>') AS source_sha256 FROM pages
""")
def markup_views(read):
    """Whole pages as shown: with a head of their own, and as source."""
    page, source = markup.with_head(F.col("html"), '<meta charset="utf-8">'), markup.source_view(F.col("html"))
    return read("pages").select("page_id", F.sha2(page, 256).alias("page_sha256"), F.sha2(source, 256).alias("source_sha256"))


@query("""
    SELECT c_custkey, 'eval_usage_' || substr(sha256('a' || chr(0) || CAST(c_custkey AS VARCHAR) || chr(0) || 't'), 1, 24) AS usage_id, 'relation_candidate_' || substr(sha256(CAST(c_custkey AS VARCHAR) || chr(0) || 'AMENDS'), 1, 24) AS relation_id,
           CASE WHEN c_custkey >= 1000 THEN 'event_' || substr(sha256(lpad(CAST(c_custkey AS VARCHAR), 8, '0') || chr(0) || 'x' || chr(0) || 'y'), 1, 24) END AS event_id FROM customer
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


@query("""
    WITH f AS (SELECT CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 1 THEN 'f' || (o_orderkey - 1) ELSE 'f' || o_orderkey END AS k, o_orderkey % 29 = 0 AS lost, o_orderkey % 6 AS p, o_custkey AS c FROM orders)
    SELECT 'FACT_ID_NOT_NULL' AS rule, '' AS key FROM f WHERE lost
    UNION ALL SELECT 'FACT_ID_UNIQUE', k FROM f WHERE NOT lost GROUP BY k HAVING count(*) > 1
    UNION ALL SELECT 'DISCLOSED_VALUE', coalesce(k, '') FROM f WHERE p = 1
    UNION ALL SELECT 'WITHHELD_UNTIL', coalesce(k, '') FROM f WHERE p = 2
    UNION ALL SELECT 'RAW_VALUE', coalesce(k, '') FROM f WHERE p = 3
    UNION ALL SELECT 'SOURCE_DOCUMENT_ID_EXISTS', coalesce(k, '') FROM f WHERE c NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
""")
def schema_problems(read):
    """Orders as facts of documents (customers), against their table: nulls, repeated keys, CHECK rules, references."""
    p, key = F.col("o_orderkey") % 6, F.col("o_orderkey")
    name = F.when(key % 29 == 0, F.lit(None)).when(key % 31 == 1, F.concat(F.lit("f"), (key - 1).cast("string"))).otherwise(F.concat(F.lit("f"), key.cast("string")))
    given = read("orders").select(
        name.alias("fact_id"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("source_document_id"), F.when(p < 2, "DISCLOSED").otherwise("MISSING").alias("value_status"), F.lit("NUMERIC").alias("value_type"),
        F.when(p == 3, " ").otherwise("-").alias("raw_value_text"), F.when(p == 0, 10).alias("numeric_value"), F.when(p == 2, F.lit("2030-01-01")).alias("withheld_until"),
    )
    fixed = {"scale": "1", "known_at": "2024-01-01 00:00:00"}
    whole = given.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in given.columns else F.lit(None if f.nullable else fixed.get(f.name, "x")).cast(f.dataType).alias(f.name) for f in schemas.schema("facts")))
    documents = read("customer").filter("c_acctbal >= 0").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("document_id"))
    return schemas.problems(whole, "facts", {"documents": documents}).select("rule", F.coalesce("key", F.lit("")).alias("key"))


#: The form of a record (its number modulo 13) and the rule that the form breaks.
_BROKEN = ((1, "split_ENUM"), (2, "DOC_GROUPS"), (3, "SLOT_NAMES"), (4, "AS_OF_DATE"), (5, "SCHEMA_VERSION"), (6, "ANSWER_AGREES"), (7, "AUTHORED_HASH"), (7, "AUTHORED_PARSER_NAME"), (8, "FACT_SLOTS_LOCK"), (8, "FACT_SLOTS_HASH"), (9, "ROUTES_COVER"), (10, "ROUTE_ALLOWED"), (11, "POINTS_UNIT"), (12, "SLOT_TEXTS"))


@query(f"""
    WITH f AS (SELECT * FROM (VALUES {', '.join(f"({p}, '{rule}')" for p, rule in _BROKEN)}) AS t(p, rule)), q AS (SELECT o_orderkey % 13 AS p, 'q' || o_orderkey AS key FROM orders)
    SELECT rule, key FROM q JOIN f USING (p)
""")
def gold_record_rules(read):
    """Orders as gold questions with slots, routes and scoring, twelve of thirteen of which break a rule."""
    k, p = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 13
    state = F.lit("ALL_REQUIRED_FACT_SLOTS_VERIFIED")
    strings = lambda *x: F.array(*(F.lit(y) for y in x)) if x else F.array().cast("array<string>")
    source = F.struct(F.concat(F.lit("d"), k).alias("document_id"), F.when(p == 12, "").otherwise("l").alias("source_locator"), F.col("o_orderpriority").alias("evidence_span"))
    slot = F.struct(F.lit("a").alias("slot_name"), F.concat(F.lit("order "), k).alias("description"), F.array(source).alias("acceptable_sources"))
    facts = F.array(F.struct(F.lit("a").alias("slot_name"), F.concat(F.lit("m"), k).alias("metric_code"), F.lit("p").alias("period_key"), F.lit("s").alias("scope")))
    route = F.struct(state.alias("when"), F.lit("STRUCTURED").alias("preferred_route"), F.when(p == 10, strings("RETRIEVAL")).otherwise(strings("STRUCTURED")).alias("allowed_routes"), strings().alias("required_operations"), strings().alias("forbidden_operations"), F.lit("SUPPORTED").alias("expected_answerability"))
    run = F.struct(
        F.when(p == 9, F.array(state, F.lit("PARSE_BLOCKED"))).otherwise(F.array(state)).alias("states"), facts.alias("slots"), F.when(p == 8, F.lit("bad")).otherwise(constraints.slots_sha256(facts)).alias("slots_sha256"), F.when(p == 8, "OPEN").otherwise("GOLD_LOCKED").alias("lock_status"), F.array(route).alias("routes")
    )
    x = F.lit("x")
    authored = F.struct(
        x.alias("corpus_snapshot_id"), F.when(p == 7, "abc").otherwise(F.sha2(k, 256)).alias("manifest_sha256"), F.when(p == 7, "").otherwise("x").alias("parser_name"), x.alias("parser_version"), x.alias("document_ir_schema_version"), F.lit("0.2.0").alias("semantic_bundle_schema_version"), x.alias("gold_revision")
    )
    answer = F.struct(F.when(p == 6, "NOT_FOUND").otherwise("SUPPORTED").alias("status"), F.col("o_totalprice").cast("string").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("reason_code"))
    scoring = F.struct(F.when(p == 11, "PERCENTAGE_POINT").otherwise("EXACT").alias("comparator"), F.lit(None).cast("double").alias("tolerance"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("rounding"))
    rows = read("orders").select(
        F.concat(F.lit("q"), k).alias("question_id"), F.lit("g").alias("evaluation_group_id"), F.when(p == 1, "TRAIN").otherwise("DEV_TUNE").alias("split"), F.lit("?").alias("question"), F.lit("SIMPLE_LOOKUP").alias("question_type"), F.lit("EASY").alias("difficulty"), F.lit("CLOSED").alias("answer_mode"),
        F.lit("SUPPORTED").alias("expected_answerability"), F.when(p == 2, strings("odd")).otherwise(strings("periodic")).alias("doc_groups"), F.when(p == 3, F.array(slot, slot)).otherwise(F.array(slot)).alias("required_evidence_slots"), strings().alias("gold_document_ids"), strings().alias("tags"),
        F.when(p == 4, "2024").alias("as_of_date"), F.when(p == 5, "0.1.0").otherwise("0.2.0").alias("schema_version"), strings().alias("expected_fact_ids"), strings().alias("expected_event_ids"), answer.alias("expected_answer"), authored.alias("authored_against"), run.alias("execution"), scoring.alias("scoring"),
    )
    return constraints.gold_record(rows).select("rule", "key")


_ASKS = Derived("orders", request_id="o_orderkey", query_id="CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat('q', o_custkey) END", retrieval_method="CASE o_orderpriority WHEN '1-URGENT' THEN 'BM25' WHEN '2-HIGH' THEN 'DENSE' WHEN '3-MEDIUM' THEN 'HYBRID_RRF' WHEN '4-NOT SPECIFIED' THEN 'HYBRID_RRF_RERANKER' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'ODD' ELSE 'BM25' END END",
                top_k="CAST(o_custkey % 105 AS INT)", index_snapshot_id="CASE WHEN o_orderkey % 9 = 0 THEN 's0' ELSE 's1' END", available="o_orderkey % 10 <> 3", n="o_orderkey % 4", form="o_orderkey % 7")


@query(f"""
    SELECT request_id, CASE WHEN query_id IS NULL OR retrieval_method = 'ODD' OR top_k NOT BETWEEN 1 AND 100 THEN 'RETRIEVER_INVALID_REQUEST' WHEN index_snapshot_id <> 's1' THEN 'RETRIEVER_SNAPSHOT_MISMATCH' WHEN NOT available THEN 'RETRIEVER_UNAVAILABLE'
        WHEN n > 0 AND (n > top_k OR form = 1 OR n > 1 AND form IN (2, 3)) THEN 'RETRIEVER_INVALID_RESULT' WHEN n > 0 AND form = 4 THEN 'RETRIEVER_REQUEST_RESULT_MISMATCH' ELSE 'OK' END AS code FROM {_ASKS}
""")
def retriever_envelope(read):
    """Orders as requests, with results whose ranks, scores, chunks or queries may be wrong."""
    asks = _ASKS(read)
    at, form = F.col("i"), F.col("form")
    found = asks.filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    rank = F.when((form == 1) & (at == F.col("n")), at + 1).otherwise(at)
    score = F.when(form == 2, at.cast("double")).otherwise(1.0 / at)
    chunk = F.when(form == 3, F.lit("c")).otherwise(F.concat(F.lit("c"), at.cast("string")))
    results = found.select("request_id", F.when(form == 4, "other").otherwise(F.col("query_id")).alias("query_id"), chunk.alias("chunk_id"), rank.alias("rank"), score.alias("score"))
    return retrieval.envelopes(asks.drop("n", "form"), results, {"index_snapshot_id": "s1"})
