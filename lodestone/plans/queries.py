"""One query for each group of operators, over the driver's tables, with the same question in SQL.

The tables stand in for the data model: orders for documents of companies (customers), line items for facts, documents
for parsed texts, pages for raw files, benchmark for evidence quotes, labels for judgements, conversations for recorded
questions and answers, events for the usage log.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import ids, markup, policy, text, values
from lodestone.operators import chunking, coverage, evaluation, ledger, profile, ranking, relations, retrieval, structured
from lodestone.sources import readers
from lodestone.sources.readers import parquet
from lodestone.sources.shared import folder, save

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (read) as a query of its name; ``read`` gives a table by name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: parquet(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _day(c: str):
    return F.col(c).cast("date")


@query("SELECT doc_id, 'file_' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(0) || source), 1, 24) AS file_id, 'chunk_' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(0) || lang || chr(0) || CAST(n_chars AS VARCHAR)), 1, 24) AS chunk_id FROM documents")
def stable_ids(read):
    return read("documents").select("doc_id", ids.stable_id("file", "doc_id", "source").alias("file_id"), ids.stable_id("chunk", "doc_id", "lang", "n_chars").alias("chunk_id"))


@query("SELECT c_custkey, lower(regexp_replace(trim(nfc_normalize(c_name)), '[\\s._\\-()\\[\\]{}''\"#]', '', 'g')) AS alias, 'alias_' || substr(sha256(CAST(c_custkey AS VARCHAR) || chr(0) || c_name), 1, 24) AS alias_id FROM customer".replace("#", ""))
def alias_dim(read):
    return read("customer").select("c_custkey", text.normal_alias(F.col("c_name")).alias("alias"), ids.stable_id("alias", "c_custkey", "c_name").alias("alias_id"))


@query("""
    SELECT c_custkey, o_orderstatus, coalesce(n, 0) AS n_documents, CASE WHEN n > 0 THEN 'PRESENT' ELSE 'ZERO_DOCUMENT' END AS coverage_state
    FROM (SELECT DISTINCT c_custkey FROM customer) CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders)
    LEFT JOIN (SELECT o_custkey AS c_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) USING (c_custkey, o_orderstatus)
""")
def coverage_grid(read):
    orders = read("orders").withColumnRenamed("o_custkey", "c_custkey")
    return coverage.grid(read("customer"), "c_custkey", orders, "o_orderstatus", orders)


@query("""
    SELECT o_orderstatus, count(*) AS n_documents, count(DISTINCT o_custkey) AS n_companies, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS n_corrections,
           sum(CASE WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) THEN 1 ELSE 0 END)::BIGINT AS n_unknown
    FROM orders GROUP BY o_orderstatus
""")
def manifest_audit(read):
    orders, known = read("orders"), read("customer").filter("c_acctbal >= 0")
    unknown = coverage.unknown_keys(orders, "o_custkey", known, "c_custkey").groupBy(F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n_unknown"))
    counts = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n_documents"), F.count_distinct("o_custkey").alias("n_companies"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_corrections"))
    return counts.join(unknown, F.col("o_orderstatus") == F.col("s"), "left").select("o_orderstatus", "n_documents", "n_companies", "n_corrections", F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))


@query("""
    SELECT rule, key, message FROM (
        SELECT 'PRICE_HIGH' AS rule, CAST(o_orderkey AS VARCHAR) AS key, 'price above 400000' AS message FROM orders WHERE o_totalprice > 400000
        UNION ALL SELECT 'STATUS_ENUM', CAST(o_orderkey AS VARCHAR), 'o_orderstatus is not one of its values' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL
        UNION ALL SELECT 'URGENT_OLD', CAST(o_orderkey AS VARCHAR), 'urgent before 1996' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1996-01-01')
""")
def manifest_constraints(read):
    rules = {
        "PRICE_HIGH": (F.col("o_totalprice") > 400000, "price above 400000"),
        "STATUS_ENUM": (~F.col("o_orderstatus").isin("F", "O") | F.col("o_orderstatus").isNull(), "o_orderstatus is not one of its values"),
        "URGENT_OLD": ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")), "urgent before 1996"),
    }
    return coverage.violations(read("orders"), "o_orderkey", rules)


@query("""
    SELECT doc_id, CASE WHEN n IS NULL THEN 'LEFT_MISSING' WHEN m IS NULL THEN 'RIGHT_MISSING' WHEN n > 1 THEN 'LEFT_DUPLICATE' WHEN m > 1 THEN 'RIGHT_DUPLICATE' END AS issue
    FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id) FULL JOIN (SELECT doc_id, count(*) AS m FROM labels GROUP BY doc_id) USING (doc_id)
    WHERE n IS NULL OR m IS NULL OR n > 1 OR m > 1
""")
def integrity_full_outer(read):
    return coverage.integrity(read("documents"), read("labels"), "doc_id")


_MANIFEST = "SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS day, o_custkey AS corp, o_orderstatus AS grp, o_orderpriority AS subtype, substr(o_orderpriority, 1, 1) AS name, year(o_orderdate) * 100 + month(o_orderdate) AS period FROM orders"


def _manifest(read):
    return read("orders").select(F.col("o_orderkey").alias("doc_id"), _day("o_orderdate").alias("day"), F.col("o_custkey").alias("corp"), F.col("o_orderstatus").alias("grp"), F.col("o_orderpriority").alias("subtype"), F.substring("o_orderpriority", 1, 1).alias("name"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("period"))


@query(f"""
    WITH m AS ({_MANIFEST}), c AS (
        SELECT s.doc_id AS source_id, d.doc_id AS target_id, d.day AS day,
               least(1.0, CASE WHEN s.subtype = d.subtype AND s.subtype <> '' THEN 0.25 ELSE 0 END + CASE WHEN s.name = d.name THEN 0.25 ELSE 0 END
                 + CASE WHEN s.period = d.period THEN 0.45 ELSE 0 END + CASE WHEN s.day - d.day <= 30 THEN 0.2 WHEN s.day - d.day <= 365 THEN 0.1 ELSE 0 END)::DOUBLE AS score
        FROM m s JOIN m d ON s.corp = d.corp AND s.grp = d.grp AND (d.day < s.day OR (d.day = s.day AND d.doc_id < s.doc_id))
        WHERE s.subtype = '1-URGENT'
    ), r AS (SELECT source_id, target_id, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, day DESC, target_id DESC) AS INTEGER) AS rank FROM c WHERE score > 0)
    SELECT source_id, target_id, score, rank FROM r WHERE rank <= 5
""")
def amends_candidates_top5(read):
    m = _manifest(read)
    found = relations.amends_candidates(m, F.col("subtype") == "1-URGENT", ["corp", "grp"], ["subtype", "name", "period"], relations.amends_score())
    return found.select(F.col("s_doc_id").alias("source_id"), F.col("d_doc_id").alias("target_id"), F.round("score", 4).alias("score"), "rank")


@query(f"""
    WITH m AS ({_MANIFEST})
    SELECT s.doc_id AS source_id, d.doc_id AS target_id, 0.25::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY d.day DESC, d.doc_id DESC) AS INTEGER) AS rank
    FROM m s JOIN m d ON s.corp = d.corp AND d.day < s.day WHERE s.subtype = '5-LOW' AND d.subtype = '2-HIGH'
""")
def termination_candidates(read):
    m = _manifest(read)
    s = m.filter("subtype = '5-LOW'").select(F.col("doc_id").alias("source_id"), "corp", F.col("day").alias("s_day"))
    d = m.filter("subtype = '2-HIGH'").select(F.col("doc_id").alias("target_id"), "corp", "day")
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("day").desc(), F.col("target_id").desc()))
    return s.join(d, "corp").filter("day < s_day").select("source_id", "target_id", F.lit(0.25).alias("score"), rank.cast("int").alias("rank"))


@query(f"SELECT corp, subtype, period, max(doc_id) AS doc_id, arg_max(day, doc_id) AS day FROM ({_MANIFEST}) GROUP BY corp, subtype, period")
def latest_version(read):
    return ranking.latest(_manifest(read), ["corp", "subtype", "period"], "doc_id").select("corp", "subtype", "period", "doc_id", "day")


@query("""
    WITH l AS (SELECT o_custkey AS corp, o_orderpriority AS subtype, year(o_orderdate) AS y, max(o_orderkey) AS doc_id FROM orders WHERE year(o_orderdate) IN (1996, 1998) GROUP BY ALL)
    SELECT corp, subtype, max(doc_id) FILTER (WHERE y = 1996) AS first_id, max(doc_id) FILTER (WHERE y = 1998) AS second_id FROM l GROUP BY corp, subtype
    HAVING count(*) FILTER (WHERE y = 1996) > 0 AND count(*) FILTER (WHERE y = 1998) > 0
""")
def period_pair(read):
    rows = read("orders").select(F.col("o_custkey").alias("corp"), F.col("o_orderpriority").alias("subtype"), F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("doc_id")).filter("y in (1996, 1998)")
    pair = rows.groupBy("corp", "subtype").pivot("y", [1996, 1998]).agg(F.max("doc_id"))
    return pair.select("corp", "subtype", F.col("1996").alias("first_id"), F.col("1998").alias("second_id")).filter("first_id is not null and second_id is not null")


@query("SELECT a.s_nationkey AS sector, a.s_suppkey AS a_id, b.s_suppkey AS b_id FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def sector_pairs(read):
    return ranking.pairs_within(read("supplier"), "s_nationkey", "s_suppkey", []).select(F.col("s_nationkey").alias("sector"), F.col("a_s_suppkey").alias("a_id"), F.col("b_s_suppkey").alias("b_id"))


@query("""
    WITH h AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('v1' || chr(0) || o_orderpriority || chr(0) || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS p, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN p <= round(n * 0.5) THEN 'DEV_TUNE' WHEN p <= round(n * 0.75) THEN 'DEV_CHECK' ELSE 'HOLDOUT' END AS split FROM h
""")
def hash_split_assignment(read):
    return ranking.split_by_targets(read("orders"), "o_orderpriority", "o_orderkey", {"DEV_TUNE": 2, "DEV_CHECK": 1, "HOLDOUT": 1}, "v1").select("o_orderkey", "split")


@query("""
    SELECT bucket, o_orderkey FROM (
        SELECT o_orderpriority AS bucket, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS p FROM (
            SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY h, o_orderkey) AS one FROM (
                SELECT o_orderpriority, o_custkey, o_orderkey, sha256('q1' || chr(0) || o_orderpriority || chr(0) || CAST(o_orderkey AS VARCHAR)) AS h FROM orders)) WHERE one = 1)
    WHERE p <= CASE bucket WHEN '1-URGENT' THEN 45 WHEN '2-HIGH' THEN 24 ELSE 12 END
""")
def quota_selection(read):
    quotas = {"1-URGENT": 45, "2-HIGH": 24, "3-MEDIUM": 12, "4-NOT SPECIFIED": 12, "5-LOW": 12}
    return ranking.quota(read("orders"), "o_orderpriority", "o_orderkey", "o_custkey", quotas, "q1").select(F.col("o_orderpriority").alias("bucket"), "o_orderkey")


@query("""
    WITH e AS (SELECT o_orderpriority AS b, o_orderkey AS k, ['c' || o_custkey, 'd' || CAST(o_orderdate AS DATE)] AS used, sha256('anchors' || chr(0) || o_orderpriority || chr(0) || CAST(o_orderkey AS VARCHAR)) AS h FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')),
    l AS (SELECT list({'k': [b || '/' || k], 'used': used} ORDER BY b, h, k) AS l FROM e),
    g AS (SELECT list_reduce(l, lambda a, x: CASE WHEN list_has_any(a.used, x.used) OR len(list_filter(a.k, lambda y: split_part(y, '/', 1) = split_part(x.k[1], '/', 1))) >= 150 THEN a ELSE {'k': list_concat(a.k, x.k), 'used': list_concat(a.used, x.used)} END) AS g FROM l),
    u AS (SELECT unnest(g.k) AS k FROM g)
    SELECT split_part(k, '/', 1) AS bucket, CAST(split_part(k, '/', 2) AS BIGINT) AS o_orderkey FROM u
""")
def unique_anchors(read):
    """Orders for review, 150 of a kind, no two with a customer or a day in common."""
    rows = read("orders").withColumn("anchors", F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("d"), F.to_date("o_orderdate").cast("string"))))
    return ranking.quota_unique_anchors(rows, "o_orderpriority", "o_orderkey", "anchors", {"1-URGENT": 150, "5-LOW": 150}, "anchors").withColumnRenamed("o_orderpriority", "bucket")


_FACTS = """SELECT 'FACT' AS record_type, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS record_id, l_suppkey AS corp, CASE l_returnflag WHEN 'A' THEN 'VERIFIED' ELSE 'CANDIDATE' END AS verification_status,
        l_shipdate AS known_at, CAST(l_shipdate AS DATE) AS period_start, CAST(l_shipdate AS DATE) + 30 AS period_end, l_extendedprice AS value FROM lineitem"""


def _facts(read):
    return read("lineitem").select(
        F.lit("FACT").alias("record_type"),
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"),
        F.col("l_suppkey").alias("corp"),
        F.when(F.col("l_returnflag") == "A", "VERIFIED").otherwise("CANDIDATE").alias("verification_status"),
        F.col("l_shipdate").alias("known_at"),
        _day("l_shipdate").alias("period_start"),
        F.date_add(_day("l_shipdate"), 30).alias("period_end"),
        F.lit(None).cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.col("l_extendedprice").alias("value"),
    )


@query(f"""
    SELECT record_id, corp, value FROM ({_FACTS})
    WHERE verification_status = 'VERIFIED' AND corp IN (1, 2, 3, 5, 8) AND period_start <= DATE '1998-12-31' AND period_end >= DATE '1998-01-01' AND CAST(known_at AS DATE) <= DATE '1998-09-30'
    ORDER BY known_at DESC, record_id LIMIT 100
""")
def structured_query(read):
    q = structured.StructuredQuery("q1", "snapshot", any_of={"corp": [1, 2, 3, 5, 8]}, period=(datetime.date(1998, 1, 1), datetime.date(1998, 12, 31)), as_of=datetime.date(1998, 9, 30))
    return structured.records(_facts(read), q).select("record_id", "corp", "value")


@query("""
    SELECT record_id, metric_code, value FROM (
        SELECT CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) AS record_id, l_quantity, l_extendedprice, l_discount FROM lineitem)
    UNPIVOT (value FOR metric_code IN (l_quantity, l_extendedprice, l_discount))
""")
def fact_unpivot(read):
    rows = read("lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("record_id"), "l_quantity", "l_extendedprice", "l_discount")
    return rows.unpivot("record_id", ["l_quantity", "l_extendedprice", "l_discount"], "metric_code", "value")


@query("SELECT l_suppkey, l_partkey, count(*) AS n_facts, count(DISTINCT l_quantity) AS n_values, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_quantity) > 1")
def fact_conflict(read):
    return structured.conflicts(read("lineitem"), ["l_suppkey", "l_partkey"], "l_quantity").select("l_suppkey", "l_partkey", "n_facts", "n_values", "low", "high")


@query("""
    WITH y AS (SELECT n_name, year(o_orderdate) AS y, sum(l_extendedprice) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
    SELECT a.n_name, a.y, round(a.s, 2) AS amount, round((a.s - b.s) / b.s * 100, 6) AS change_percent, CASE WHEN b.s IS NULL THEN 'ARITY' END AS error FROM y a LEFT JOIN y b ON a.n_name = b.n_name AND a.y = b.y + 1
""")
def calculator_yoy(read):
    nations = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = read("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice").join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(read("orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name", "y").agg(F.sum("l_extendedprice").alias("s"))
    before = F.lag("s").over(Window.partitionBy("n_name").orderBy("y"))
    before = F.when(F.lag("y").over(Window.partitionBy("n_name").orderBy("y")) == F.col("y") - 1, before)
    inputs = F.filter(F.array(before, "s"), lambda x: x.isNotNull())
    out = values.calculate(F.lit("PERCENTAGE_CHANGE"), inputs, F.array(F.lit("KRW")))
    return rows.withColumn("r", out).select("n_name", "y", F.round("s", 2).alias("amount"), F.round("r.value", 6).alias("change_percent"), F.col("r.error").alias("error"))


@query("""
    WITH a AS (SELECT o_orderkey AS id, o_custkey AS corp, o_orderpriority AS name, o_orderstatus AS party, year(o_orderdate) AS started, month(o_orderdate) AS ended, floor(o_totalprice / 100000) AS amount, o_orderdate AS day FROM orders),
    c AS (SELECT s.id AS source_id, d.id AS target_id, d.day,
            round(CASE WHEN s.name = d.name THEN 0.35 ELSE 0 END + CASE WHEN s.party = d.party THEN 0.25 ELSE 0 END + CASE WHEN s.amount = d.amount THEN 0.2 ELSE 0 END + CASE WHEN s.started = d.started THEN 0.1 ELSE 0 END + CASE WHEN s.ended = d.ended THEN 0.1 ELSE 0 END, 4)::DOUBLE AS score,
            (s.name = d.name)::INT + (s.party = d.party)::INT + (s.amount = d.amount)::INT + (s.started = d.started)::INT + (s.ended = d.ended)::INT AS matches
          FROM a s JOIN a d ON s.corp = d.corp AND s.day > d.day WHERE s.name = '5-LOW'),
    r AS (SELECT *, 5 - matches AS against, lead(score) OVER w AS second, row_number() OVER w AS rank FROM c WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, 5 - matches, day DESC, target_id))
    SELECT source_id, target_id, score, CASE WHEN score >= 0.7 AND matches >= 2 AND against <= 1 AND (second IS NULL OR round(score - second, 4) >= 0.2) THEN 'HIGH_CONFIDENCE_REVIEW' ELSE 'MANUAL_DISAMBIGUATION_REQUIRED' END AS status FROM r WHERE rank = 1
""")
def identity_match(read):
    a = read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("corp"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("party"), F.year("o_orderdate").alias("started"), F.month("o_orderdate").alias("ended"), F.floor(F.col("o_totalprice") / 100000).alias("amount"), F.col("o_orderdate").alias("day"))
    s, d = (a.select(*(F.col(c).alias(f"{side}_{c}") for c in a.columns)) for side in "sd")
    rows = s.filter("s_name = '5-LOW'").join(d, (F.col("s_corp") == F.col("d_corp")) & (F.col("s_day") > F.col("d_day")))
    weights = {"name": 0.35, "party": 0.25, "amount": 0.20, "started": 0.10, "ended": 0.10}
    score, matches, against = relations.identity_score(weights, {k: F.col(f"s_{k}") == F.col(f"d_{k}") for k in weights})
    rows = rows.select(F.col("s_id").alias("source_id"), F.col("d_id").alias("target_id"), "d_day", score.alias("score"), matches.alias("matches"), against.alias("contradictions"))
    best = relations.decided(rows, "source_id", [F.col("score").desc(), "contradictions", F.col("d_day").desc(), "target_id"])
    return best.select("source_id", "target_id", "score", "status")


@query("""
    WITH s AS (SELECT o_orderkey AS id, o_custkey AS corp, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS ref_day, o_orderpriority AS fam FROM orders WHERE o_orderstatus = 'P'),
    d AS (SELECT o_orderkey AS id, o_custkey AS corp, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS fam FROM orders),
    j AS (SELECT s.id, s.ref_day, d.id AS target, d.id IS NOT NULL AND (contains(d.fam, s.fam) OR contains(s.fam, d.fam)) AS kin FROM s LEFT JOIN d ON s.corp = d.corp AND s.ref_day = d.day AND s.id <> d.id),
    g AS (SELECT id, ref_day, count(DISTINCT target) FILTER (WHERE kin) AS k, count(DISTINCT target) AS n FROM j GROUP BY ALL)
    SELECT id AS doc_id, CASE WHEN ref_day IS NULL THEN 'REFERENCE_NOT_PARSED' WHEN n = 0 THEN 'TARGET_NOT_IN_CORPUS' WHEN CASE WHEN k > 0 THEN k ELSE n END = 1 THEN 'MATCHED_IN_CORPUS' ELSE 'AMBIGUOUS' END AS status, CASE WHEN k > 0 THEN k ELSE n END AS n_targets FROM g
""")
def correction_reference(read):
    o = read("orders")
    day = F.when(F.col("o_orderkey") % 7 != 0, _day("o_orderdate"))
    s = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("corp"), day.alias("ref_day"), F.col("o_orderpriority").alias("ref_family"))
    d = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("corp"), _day("o_orderdate").alias("day"), F.col("o_orderpriority").alias("family"))
    return relations.references(s, d).select("doc_id", "status", F.size("targets").cast("long").alias("n_targets"))


@query("""
    WITH s AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'PARSE_FAILED' ELSE 'PRESENT' END AS cov, CASE o_orderkey % 4 WHEN 0 THEN 'MATCHED_IN_CORPUS' WHEN 1 THEN 'TARGET_NOT_IN_CORPUS' WHEN 2 THEN 'AMBIGUOUS' ELSE 'REFERENCE_NOT_PARSED' END AS ref, o_custkey % 3 AS n FROM orders),
    t AS (SELECT CASE WHEN cov <> 'PRESENT' THEN 'PARSE_BLOCKED' WHEN ref = 'MATCHED_IN_CORPUS' THEN 'READY_FOR_HUMAN_REVIEW' WHEN ref = 'TARGET_NOT_IN_CORPUS' THEN 'TARGET_OUTSIDE_CORPUS_REVIEW' WHEN ref = 'AMBIGUOUS' OR n > 0 THEN 'AMBIGUOUS_REVIEW' ELSE 'NO_TARGET_CANDIDATE_REVIEW' END AS status, ref FROM s)
    SELECT 'status' AS dimension, status AS value, count(*) AS n FROM t GROUP BY status UNION ALL SELECT 'reference', ref, count(*) FROM t GROUP BY ref
""")
def relation_status_report(read):
    ref = F.when(F.col("o_orderkey") % 4 == 0, "MATCHED_IN_CORPUS").when(F.col("o_orderkey") % 4 == 1, "TARGET_NOT_IN_CORPUS").when(F.col("o_orderkey") % 4 == 2, "AMBIGUOUS").otherwise("REFERENCE_NOT_PARSED")
    cov = F.when(F.col("o_orderstatus") == "P", "PARSE_FAILED").otherwise("PRESENT")
    rows = read("orders").select(relations.amends_status(cov, ref, F.col("o_custkey") % 3).alias("status"), ref.alias("reference"))
    return profile.grouping_report(rows, ["status", "reference"], [F.count("*").alias("n")])


_EDGES = "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus AND b.o_orderkey > a.o_orderkey AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 200"


@query(f"""
    WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach(id, r) AS (SELECT o_orderkey, o_orderkey FROM orders UNION SELECT reach.id, u.b FROM reach JOIN u ON reach.r = u.a)
    SELECT id AS doc_id, min(r) AS chain_id FROM reach GROUP BY id
""")
def chain_components(read):
    o = read("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", _day("o_orderdate").alias("day"))
    a, b = (o.select(*(F.col(c).alias(f"{s}_{c}") for c in o.columns)) for s in "ab")
    same = (F.col("a_o_custkey") == F.col("b_o_custkey")) & (F.col("a_o_orderpriority") == F.col("b_o_orderpriority")) & (F.col("a_o_orderstatus") == F.col("b_o_orderstatus"))
    near = F.abs(F.datediff("a_day", "b_day")) <= 200
    edges = a.join(b, same & (F.col("b_o_orderkey") > F.col("a_o_orderkey")) & near).select(F.col("a_o_orderkey").alias("a"), F.col("b_o_orderkey").alias("b"))
    return relations.chains(o.select(F.col("o_orderkey").alias("doc_id")), edges)


_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
_N_TOKENS = f"len(regexp_extract_all(text, '{_TOKEN}'))"


@query(f"SELECT doc_id, {_N_TOKENS} AS n_tokens FROM documents")
def token_counts(read):
    return read("documents").select("doc_id", text.n_tokens(F.col("text")).cast("long").alias("n_tokens"))


@query(f"""
    WITH t AS (SELECT doc_id, {_N_TOKENS} AS n FROM documents), w AS (SELECT doc_id, n, CASE WHEN n <= 0 THEN 0 WHEN n <= 512 THEN 1 ELSE CAST(ceil((n - 512) / 448.0) AS INT) + 1 END AS k FROM t)
    SELECT doc_id, CAST(i AS INTEGER) AS "window", CAST(i * 448 AS INTEGER) AS token_start, CAST(least(i * 448 + 512, n) AS INTEGER) AS token_end FROM w, unnest(range(k)) AS r(i)
""")
def fixed_token_windows(read):
    return chunking.token_windows(read("documents"), "doc_id", "text", 512, 64)


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), g AS (SELECT sha256(line) AS f, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM l GROUP BY f)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, count(*) FILTER (WHERE n > 1) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, count(*) FILTER (WHERE n > 1 AND low <> high) AS n_cross, sum(n - 1) / sum(n) AS duplicate_rate FROM g
""")
def duplicate_profile(read):
    lines = read("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", F.sha2("line", 256).alias("f"))
    return profile.duplicate_profile(lines, "f", "doc_id")


@query("""
    SELECT sha256(text) AS content_sha256, count(*) AS n, count(DISTINCT source) AS n_sources, left(min(text), 40) AS preview FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, content_sha256 LIMIT 20
""")
def top_duplicates(read):
    rows = read("documents").select(F.sha2("text", 256).alias("content_sha256"), "source", F.left("text", F.lit(40)).alias("p"))
    groups = rows.groupBy("content_sha256").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.min("p").alias("preview"))
    return groups.filter("n > 1").orderBy(F.col("n").desc(), "content_sha256").limit(20)


@query("SELECT event_type, count(DISTINCT user_id) AS n_exact, true AS within FROM events GROUP BY event_type")
def approx_distinct(read):
    """Distinct users by a sketch: whether each count is within 2 percent of the exact one."""
    events = read("events")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_exact"))
    found = profile.approximate_distinct(events, ["event_type"], "user_id").join(exact, "event_type")
    return found.select("event_type", "n_exact", (F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.col("n_exact") * profile.DISTINCT_BOUND).alias("within"))


@query("""
    SELECT l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS total, min(l_orderkey) AS low, max(l_orderkey) AS high, count(DISTINCT l_partkey) AS exact_distinct,
           true AS distinct_within, true AS p50_within, true AS p90_within, true AS p99_within
    FROM lineitem GROUP BY l_returnflag
""")
def sketch_profile(read):
    """Sketches by supplier and flag, merged to flags, held against exact figures."""
    qs = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    rows = read("lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_partkey")
    fine = profile.sketches(rows, ["l_suppkey", "l_returnflag"], "l_orderkey", "l_partkey")
    found = profile.estimates(profile.merged(fine, ["l_returnflag"]), ["l_returnflag"], qs)
    held = profile.held_against(found, rows, ["l_returnflag"], "l_orderkey", "l_partkey", qs)
    return found.select("l_returnflag", "n", "total", "low", "high").join(held, "l_returnflag")


@query("""
    SELECT source, count(*) FILTER (WHERE doc_id % 50 <> 7) AS n_rows, count(*) FILTER (WHERE doc_id % 50 = 7) AS n_rejects, coalesce(sum(length(text)) FILTER (WHERE doc_id % 50 <> 7), 0)::BIGINT AS n_chars FROM documents GROUP BY source
""")
def jsonl_roundtrip(read):
    """All documents as JSON lines, every 50th cut short, written by source and read again with rejects."""
    docs = read("documents")
    line = F.to_json(F.struct("doc_id", "source", "text"))
    broken = F.concat(F.lit('{"source":"'), "source", F.lit('","doc_id":'))
    path = folder(docs.sparkSession, "lines")
    docs.select(F.when(F.col("doc_id") % 50 == 7, broken).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.jsonl_with_rejects(docs.sparkSession, path, docs.select("doc_id", "source", "text").schema)
    rows = good.select("source", F.length("text").alias("n"), F.lit(1).alias("ok")).unionByName(bad.select(F.regexp_extract("raw", '"source":"([^"]*)"', 1).alias("source"), F.lit(0).alias("n"), F.lit(0).alias("ok")))
    return rows.groupBy("source").agg(F.sum("ok").cast("long").alias("n_rows"), F.count_if(F.col("ok") == 0).alias("n_rejects"), F.sum("n").cast("long").alias("n_chars"))


@query("""
    WITH d AS (SELECT source, sum(strlen(text) + 1)::BIGINT AS n_bytes, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents GROUP BY source)
    SELECT source, n_bytes, n_lines FROM d
""")
def file_inventory(read):
    """Texts as raw files, one folder a source: bytes and lines by source, from the files' own content."""
    docs = read("documents")
    path = folder(docs.sparkSession, "files")
    docs.select("text", "source").write.partitionBy("source").text(path)
    files = readers.inventory(readers.raw_tree(docs.sparkSession, path)).withColumn("source", F.regexp_extract("path", "source=([^/]*)/", 1))
    return files.groupBy("source").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_lines").alias("n_lines"))


@query("""
    WITH l AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '사용자' WHEN 'assistant' THEN '도우미' ELSE 'System' END || conv_id * 7919 % 100003 || CASE WHEN conv_id % 2 = 0 THEN ' A' ELSE ' a' END || turn AS label, role FROM conversations)
    SELECT conv_id, turn, label, CAST(rank() OVER (PARTITION BY turn ORDER BY CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, conv_id * 7919 % 100003) AS INTEGER) AS place FROM l
""")
def korean_order(read):
    """Labels in Korean order: Hangul before Latin, numbers by size, case aside."""
    head = F.when(F.col("role") == "user", "사용자").when(F.col("role") == "assistant", "도우미").otherwise("System")
    label = F.concat(head, (F.col("conv_id") * 7919 % 100003).cast("string"), F.when(F.col("conv_id") % 2 == 0, " A").otherwise(" a"), F.col("turn").cast("string"))
    rows = read("conversations").select("conv_id", "turn", label.alias("label"))
    return rows.withColumn("place", F.rank().over(Window.partitionBy("turn").orderBy(values.natural_key(F.col("label")))))


@query("""
    SELECT source, list_sort(list(n_chars))[CAST(floor((count(*) - 1) * 0.5) AS INT) + 1] AS p50, list_sort(list(n_chars))[CAST(floor((count(*) - 1) * 0.9) AS INT) + 1] AS p90, list_sort(list(n_chars))[CAST(floor((count(*) - 1) * 0.99) AS INT) + 1] AS p99 FROM documents GROUP BY source
""")
def percentile_lower(read):
    return profile.percentile_lower_grouped(read("documents"), ["source"], "n_chars", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentile_nearest(read):
    return read("events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("""
    SELECT 'lang' AS dimension, coalesce(lang, 'UNKNOWN') AS value, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL
    UNION ALL SELECT 'source', coalesce(source, 'UNKNOWN'), count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY ALL
""")
def multi_dim_report(read):
    return profile.grouping_report(read("documents"), ["lang", "source"], [F.count("*").alias("n"), F.sum("n_chars").alias("chars")])


@query("""
    SELECT source, n, n::DOUBLE / (SELECT count(*) FROM documents WHERE source = 'src0') AS ratio FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
""")
def ratio_to_baseline(read):
    return profile.ratio_to_baseline(read("documents").groupBy("source").agg(F.count("*").alias("n")), "source", "n", "src0")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def last_section_asof(read):
    return chunking.last_section(read("conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", "section")


@query(f"""
    WITH RECURSIVE t AS (SELECT conv_id, turn, {_N_TOKENS} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    p(conv_id, i, turn, n, pack, windows, next, tokens, cnt) AS (
        SELECT conv_id, i, turn, n, 0::BIGINT, CASE WHEN n > 128 THEN CAST(ceil(n / 128.0) AS BIGINT) ELSE 1 END, CASE WHEN n > 128 THEN CAST(ceil(n / 128.0) AS BIGINT) ELSE 0 END, CASE WHEN n > 128 THEN 0 ELSE n END, CASE WHEN n > 128 THEN 0 ELSE 1 END FROM t WHERE i = 1
        UNION ALL
        SELECT q.conv_id, q.i, q.turn, q.n, q.at, q.w, CASE WHEN q.n > 128 THEN q.at + q.w ELSE q.at END, CASE WHEN q.n > 128 THEN 0 WHEN q.shut THEN q.n ELSE q.tokens + q.n END, CASE WHEN q.n > 128 THEN 0 WHEN q.shut THEN 1 ELSE q.cnt + 1 END
        FROM (SELECT t.conv_id, t.i, t.turn, t.n, p.tokens, p.cnt, (p.cnt > 0 AND (t.n > 128 OR p.tokens + t.n > 128 OR p.cnt >= 4)) AS shut, p.next + CASE WHEN p.cnt > 0 AND (t.n > 128 OR p.tokens + t.n > 128 OR p.cnt >= 4) THEN 1 ELSE 0 END AS at, CASE WHEN t.n > 128 THEN CAST(ceil(t.n / 128.0) AS BIGINT) ELSE 1 END AS w
              FROM p JOIN t ON t.conv_id = p.conv_id AND t.i = p.i + 1) q)
    SELECT conv_id, turn, n AS n_tokens, pack, windows FROM p
""")
def pack_segments(read):
    rows = read("conversations").select("conv_id", "turn", text.n_tokens(F.col("text")).cast("long").alias("n_tokens"))
    return chunking.pack(rows, ["conv_id"], ["turn"], "n_tokens", 128, 4).withColumnRenamed("pack_windows", "windows")


@query("""
    WITH h AS (SELECT doc_id, item_id, d.text AS text, strpos(d.text, b.text) AS a_start, strpos(d.text, b.text) + length(b.text) - 1 AS a_end FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE doc_id IN (SELECT doc_id FROM h)),
    s AS (SELECT doc_id, line_no, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) AS BIGINT) AS b_start, length(line) AS n FROM l)
    SELECT doc_id, item_id, CAST(line_no AS INTEGER) AS line_no FROM h JOIN s USING (doc_id) WHERE n > 0 AND a_start <= b_start + n - 1 AND b_start <= a_end
""")
def evidence_overlap(read):
    """The lines of each document that a quote of the benchmark touches."""
    docs, bench = read("documents").select("doc_id", "text"), read("benchmark").select("item_id", F.col("text").alias("quote"))
    at = F.position("quote", "text")
    found = quote_containment(read).join(docs, "doc_id").join(bench, "item_id").select("doc_id", "item_id", at.alias("a_start"), (at + F.length("quote") - 1).alias("a_end"))
    lines = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    start = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("line_no")) - F.length("line")
    spans = lines.select("doc_id", "line_no", start.alias("b_start"), (start + F.length("line") - 1).alias("b_end")).filter("b_end >= b_start")
    return retrieval.overlaps(found, spans, ["doc_id"]).select("doc_id", "item_id", "line_no")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_containment(read):
    return retrieval.containing(read("documents"), "doc_id", "text", read("benchmark"), "item_id", "text")


@query("SELECT doc_id, CASE WHEN strpos(text, 'idiot') > 0 THEN substr(text, greatest(strpos(text, 'idiot') - 160, 1), strpos(text, 'idiot') - greatest(strpos(text, 'idiot') - 160, 1) + 165) END AS snippet FROM documents WHERE contains(text, 'idiot')")
def snippet(read):
    return read("documents").select("doc_id", text.snippet(F.col("text"), F.lit("idiot")).alias("snippet")).filter("snippet is not null")


@query(r"""
    SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<iframe\b[^>]*>.*?</iframe>', '', 'g'), '(?is)<object\b[^>]*>.*?</object>', '', 'g'),
        '(?i)\son[a-z]+\s*=\s*(?:"[^"\n]*"|''[^''\n]*'')', '', 'g'), '(?i)\s(?:href|src)\s*=\s*(?:"javascript:[^"\n]*"|''javascript:[^''\n]*'')', '', 'g')) AS clean_sha256 FROM pages
""")
def html_sanitize(read):
    return read("pages").select("page_id", F.sha2(markup.sanitize(F.col("html")), 256).alias("clean_sha256"))


@query("""
    WITH p AS (SELECT page_id, url, lower(ltrim(substr(html, 1, 512))) AS h FROM pages)
    SELECT page_id, CASE WHEN starts_with(h, '%pdf') THEN 'PDF' WHEN starts_with(h, '<!doctype html') OR starts_with(h, '<html') THEN 'HTML' WHEN starts_with(h, '<?xml') OR starts_with(h, '<document') THEN 'XML' WHEN starts_with(h, '{') OR starts_with(h, '[') THEN 'JSON' WHEN length(h) > 0 THEN 'TEXT' ELSE 'UNKNOWN' END AS format FROM p
""")
def format_sniff(read):
    return read("pages").select("page_id", markup.sniff_format(F.col("html")).alias("format"))


@query(r"""
    SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)ignore\s+(all\s+)?(the\s+)?(previous|prior|above)\s+instructions') OR regexp_matches(text, '(?i)\byou\s+are\s+now\b') THEN 'POLICY_PROMPT_INJECTION_DETECTED'
        WHEN regexp_matches(text, '(?i)\b(buy|sell)\s+this\s+stock\b') OR regexp_matches(text, '(?i)\binvestment\s+advice\b') THEN 'POLICY_INVESTMENT_ADVICE_FORBIDDEN' END AS code FROM conversations
""")
def policy_guard(read):
    return read("conversations").select("conv_id", "turn", policy.answer_code(F.col("text")).alias("code"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, v.vec_id, round(list_cosine_similarity(q.e, v.embedding::DOUBLE[]), 6) AS score FROM q, embeddings v WHERE v.vec_id <> query_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, vec_id, rank, score FROM r WHERE rank <= 10
""")
def dense_topk(read):
    v = read("embeddings")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("e"))
    return retrieval.dense(v, "vec_id", "embedding", asked, "query_id", "e", 10)


def _bm25(of: str, p: str = "") -> str:
    """SQL of the BM25 ranking r (by item) of the documents' ``of``; p: a prefix of all names."""
    return f"""
    {p}t AS (SELECT doc_id, unnest(regexp_extract_all(lower({of}), '{_TOKEN}')) AS term FROM documents),
    {p}l AS (SELECT doc_id, {_N_TOKENS.replace("text", f"lower({of})")} AS len FROM documents), {p}g AS (SELECT count(*) AS n, avg(len) AS mean FROM {p}l),
    {p}tf AS (SELECT doc_id, term, count(*) AS tf FROM {p}t GROUP BY ALL), {p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
    {p}q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM benchmark),
    {p}s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM {p}q JOIN {p}tf USING (term) JOIN {p}df USING (term) JOIN {p}l USING (doc_id), {p}g GROUP BY ALL),
    {p}r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {p}s)"""


_BM25 = _bm25("text")


@query(f"WITH {_BM25} SELECT item_id, doc_id, rank, score FROM r WHERE rank <= 10")
def bm25_topk(read):
    return retrieval.bm25(read("documents"), "doc_id", "text", read("benchmark"), "item_id", "text", 10)


@query(f"""
    WITH {_BM25}, {_bm25("split_part(text, chr(10), 1)", "x")}, f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT item_id, doc_id, rank FROM r WHERE rank <= 50 UNION ALL SELECT item_id, doc_id, rank FROM xr WHERE rank <= 50) GROUP BY ALL),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f)
    SELECT item_id, doc_id, rank, score FROM o WHERE rank <= 10
""")
def hybrid_rrf(read):
    """Rankings by the whole text and by its first line, fused."""
    docs, bench = read("documents"), read("benchmark")
    first = docs.select("doc_id", F.substring_index("text", "\n", 1).alias("line"))
    lists = [retrieval.bm25(d, "doc_id", c, bench, "item_id", "text", 50) for d, c in ((docs, "text"), (first, "line"))]
    return retrieval.rrf(lists, "item_id", "doc_id", 10).select("item_id", "doc_id", "rank", "score")


@query(f"""
    WITH {_BM25}, rel AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    h AS (SELECT item_id, min(rank) AS first FROM (SELECT * FROM r WHERE rank <= 10) JOIN rel USING (item_id, doc_id) GROUP BY item_id)
    SELECT count(*) AS n_queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0.0 END), 6) AS mrr_10
    FROM (SELECT DISTINCT item_id FROM rel) LEFT JOIN h USING (item_id)
""")
def retrieval_metrics(read):
    return retrieval.recall_mrr(bm25_topk(read), quote_containment(read), "item_id", "doc_id")


@query("""
    WITH j AS (SELECT doc_id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)), s AS (
        SELECT doc_id, CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS answerability, CASE WHEN abs(n_chars - 2000) <= 2000 * 0.5 THEN 'PASS' ELSE 'FAIL' END AS amount, CASE WHEN toxic = 1 THEN 'NOT_SCORED' WHEN n_chars BETWEEN 100 AND 5000 THEN 'PASS' ELSE 'FAIL' END AS span FROM j)
    SELECT metric, count(*) FILTER (WHERE status = 'PASS') AS n_pass, count(*) FILTER (WHERE status = 'FAIL') AS n_fail, count(*) FILTER (WHERE status = 'NOT_SCORED') AS n_not_scored, count(*) FILTER (WHERE status = 'REVIEW_REQUIRED') AS n_review_required
    FROM (SELECT doc_id, answerability, amount, span, CASE WHEN answerability = 'PASS' AND amount = 'PASS' AND span = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS whole FROM s) UNPIVOT (status FOR metric IN (answerability, amount, span, whole)) GROUP BY metric
""")
def closed_scoring(read):
    j = read("labels").join(read("documents").select("doc_id", "n_chars"), "doc_id")
    n, none = F.col("n_chars").cast("double"), F.lit(None).cast("double")
    rows = j.select(
        F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("answerability"),
        evaluation.numeric_match(F.lit("RELATIVE"), F.lit(2000.0), n, F.lit(0.5)).alias("amount"),
        evaluation.numeric_match(F.when(F.col("toxic") != 1, "RANGE"), none, n, none, F.lit(100.0), F.lit(5000.0)).alias("span"),
    ).withColumn("whole", evaluation.object_status(F.array("answerability", "amount", "span")))
    metrics = rows.unpivot([], ["answerability", "amount", "span", "whole"], "metric", "status")
    return evaluation.tally(metrics, ["metric"])


@query("SELECT count(*) AS n_runs, count(*) FILTER (WHERE event_type <> 'error') AS n_ok, count(DISTINCT CASE WHEN event_type = 'error' THEN props END) AS n_error_classes, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events")
def harness_summary(read):
    rows = read("events").select((F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"), F.col("value").alias("latency"))
    return evaluation.summary(rows, "ok", "error", "latency")


@query("""
    WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 < 5 THEN 'DEV_TUNE' WHEN doc_id % 10 < 7 THEN 'DEV_CHECK' ELSE 'HOLDOUT' END AS split, sha256(text) AS h, source FROM documents)
    SELECT kind, key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM (SELECT 'text' AS kind, h AS key, split FROM s UNION ALL SELECT 'source', source, split FROM s) GROUP BY kind, key HAVING count(DISTINCT split) > 1
""")
def leakage(read):
    part = F.col("doc_id") % 10
    rows = read("documents").select(F.when(part < 5, "DEV_TUNE").when(part < 7, "DEV_CHECK").otherwise("HOLDOUT").alias("split"), F.sha2("text", 256).alias("h"), "source")
    return evaluation.leakage(rows, "split", {"text": "h", "source": "source"}).select("kind", "key", F.array_join("splits", ",").alias("splits"))


@query("""
    WITH f AS (SELECT event_id, first_value(event_type) OVER w AS t, event_type, CAST(floor(value / 50) AS BIGINT) AS v, first_value(CAST(floor(value / 50) AS BIGINT)) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, concat_ws(',', CASE WHEN event_type <> t THEN 'event_type' END, CASE WHEN v <> b THEN 'band' END) AS drifted FROM f WHERE event_type <> t OR v <> b
""")
def round_drift(read):
    rows = read("events").withColumn("band", F.floor(F.col("value") / 50))
    return evaluation.drift(rows, "user_id", ["ts", "event_id"], ["event_type", "band"]).select("event_id", F.array_join("drifted", ",").alias("drifted"))


@query("""
    WITH h AS (SELECT event_id, user_id, ts, sha256(CAST(event_id AS VARCHAR)) AS own, sha256(CAST(event_id - 50 AS VARCHAR)) AS previous FROM events), l AS (SELECT *, lag(own) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS expected FROM h)
    SELECT event_id, user_id FROM l WHERE previous IS DISTINCT FROM expected
""")
def ledger_chain(read):
    rows = read("events").select("event_id", "user_id", "ts", F.sha2(F.col("event_id").cast("string"), 256).alias("own"), F.sha2((F.col("event_id") - 50).cast("string"), 256).alias("previous"))
    return ledger.chain_breaks(rows, ["user_id"], ["ts", "event_id"], "previous", "own").select("event_id", "user_id")


@query("""
    WITH l AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT event_id, before, event_type FROM l WHERE before IS NOT NULL AND NOT ((before, event_type) IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('purchase', 'view')))
""")
def state_machine(read):
    steps = (("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "view"))
    return ledger.illegal_steps(read("events"), "user_id", ["ts", "event_id"], "event_type", steps).select("event_id", "before", "event_type")


@query("""
    SELECT doc_id, 'LEFT_ONLY' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'RIGHT_ONLY' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
    UNION ALL SELECT doc_id, 'BOTH' FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
""")
def set_ops(read):
    a, b = read("documents").select("doc_id"), read("labels").select("doc_id")
    return coverage.set_difference(a, b, "doc_id").unionByName(a.intersect(b).withColumn("side", F.lit("BOTH")))


@query(r"""
    WITH c AS (SELECT o_orderkey, o_orderkey % 6 AS k, CASE o_orderkey % 6 WHEN 0 THEN '-' WHEN 1 THEN '해당없음' WHEN 2 THEN CAST(o_orderkey * 1000 AS VARCHAR) || '(예정)' WHEN 3 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 4 THEN 'n/a' ELSE printf('%d,000', o_orderkey) END AS raw, o_orderstatus = 'P' AS withheld FROM orders)
    SELECT o_orderkey, CASE WHEN k IN (1, 4) THEN 'NOT_APPLICABLE' WHEN k = 0 AND withheld THEN 'WITHHELD' WHEN k IN (0, 3) THEN 'MISSING' ELSE 'DISCLOSED' END AS status,
           CASE WHEN k = 2 THEN 'PLANNED' WHEN k = 5 THEN 'CONFIRMED' ELSE 'NOT_RELEVANT' END AS certainty, CASE WHEN k IN (2, 5) THEN CAST(o_orderkey * 1000 AS DOUBLE) END AS numeric_value FROM c
""")
def value_status(read):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "-").when(k == 1, "해당없음").when(k == 2, F.concat((F.col("o_orderkey") * 1000).cast("string"), F.lit("(예정)"))).when(k == 3, F.date_format("o_orderdate", "yyyy.MM.dd")).when(k == 4, "n/a").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(",000")))
    v = values.value_status(raw, "NUMERIC", F.lit("CONTRACT_AMOUNT"), F.col("o_orderstatus") == "P")
    return read("orders").withColumn("v", v).select("o_orderkey", "v.status", "v.certainty", F.col("v.numeric_value").cast("double").alias("numeric_value"))


@query("""
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS whole, CAST(o_orderdate AS DATE) AS found, CAST(o_orderdate AS DATE) AS receipt, CAST(o_orderdate AS TIMESTAMP) - INTERVAL 9 HOUR AS known_at FROM orders
""")
def parse_dates(read):
    d = F.col("o_orderdate")
    return read("orders").select(
        "o_orderkey",
        text.parse_date(F.concat(F.year(d).cast("string"), F.lit("년 "), F.month(d).cast("string"), F.lit("월 "), F.day(d).cast("string"), F.lit("일"))).alias("whole"),
        F.coalesce(text.find_date(F.concat(F.lit("제출일 "), F.date_format(d, "yyyy-MM-dd"), F.lit(" 제출"))), text.parse_date(F.date_format(d, "yyyy/M/d"))).alias("found"),
        text.receipt_date(F.date_format(d, "yyyyMMdd")).alias("receipt"),
        text.known_at(_day("o_orderdate")).cast("timestamp_ntz").alias("known_at"),
    )


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') AND contains(lower(concat_ws(' ', c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR))), '99')")
def viewer_search(read):
    words = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")))
    return read("customer").filter(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD") & words.contains("99")).select("c_custkey")


@query("""
    SELECT o_orderkey, concat_ws(',', CASE WHEN regexp_full_match(q, '[0-9\\s.,-]*') THEN 'NUMERIC_OR_SYMBOL_ONLY' END, CASE WHEN length(q) <= 8 THEN 'SHORT_QUOTE' END, CASE WHEN n > 1 THEN 'DUPLICATE_QUOTE' END) AS flags,
           CASE WHEN regexp_full_match(q, '[0-9\\s.,-]*') THEN 'CRITICAL' WHEN length(q) <= 8 OR n > 1 THEN 'HIGH' ELSE 'MEDIUM' END AS level
    FROM (SELECT o_orderkey, q, count(*) OVER (PARTITION BY q) AS n FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN o_orderpriority ELSE 'order number ' || CAST(o_orderkey AS VARCHAR) END AS q FROM orders))
""")
def risk_flags(read):
    q = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).otherwise(F.concat(F.lit("order number "), F.col("o_orderkey").cast("string")))
    rows = read("orders").select("o_orderkey", q.alias("q"))
    counts = rows.groupBy(F.col("q").alias("c_q")).agg(F.count("*").alias("n"))  # a frequent quote is counted before it is moved
    flags = values.risk_flags(F.col("q"), F.col("n") > 1, F.lit(False), F.lit(False))
    rows = rows.join(counts, F.col("q") == F.col("c_q")).withColumn("f", flags)
    return rows.select("o_orderkey", F.array_join("f", ",").alias("flags"), values.risk_level(F.col("f")).alias("level"))


@query("SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def unique_links(read):
    return evaluation.unique_first(read("lineitem"), ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey", "l_extendedprice"]).select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")


@query("""
    WITH b AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'WITHHELD' WHEN bool_or(o_orderstatus = 'O') THEN 'NOT_APPLICABLE' ELSE 'SUPPORTED' END AS answerability FROM b GROUP BY o_custkey
""")
def answerability(read):
    status = F.when(F.col("o_orderstatus") == "P", "WITHHELD").when(F.col("o_orderstatus") == "O", "NOT_APPLICABLE").otherwise("DISCLOSED")
    return read("orders").groupBy("o_custkey").agg(F.collect_set(status).alias("s")).select("o_custkey", values.answerability(F.col("s")).alias("answerability"))


@query(r"""SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_sha256, regexp_replace(url, '(?i)(token|secret)\s*[:=]\s*\S+', '\1=[REDACTED]', 'g') AS safe_url FROM pages""")
def escape_and_redact(read):
    return read("pages").select("page_id", F.sha2(markup.escape_html(F.col("html")), 256).alias("escaped_sha256"), text.redact(F.col("url")).alias("safe_url"))


@query("""
    SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def usage_windows(read):
    from lodestone.streaming.ledger import windowed_usage

    rows = windowed_usage(read("events"), ["event_type"])
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", F.round("total", 4).alias("total"))


@query("""
    WITH t AS (SELECT doc_id % 3 AS b, CASE WHEN doc_id % 10 < 5 THEN 'DEV_TUNE' WHEN doc_id % 10 < 7 THEN 'DEV_CHECK' ELSE 'HOLDOUT' END AS split FROM documents)
    SELECT CAST(b AS VARCHAR) AS bucket, split, count(*) AS n, 100::BIGINT AS target, 100 - count(*) AS missing FROM t GROUP BY ALL
""")
def split_allocation(read):
    docs = read("documents")
    part = F.col("doc_id") % 10
    queue = docs.select((F.col("doc_id") % 3).cast("string").alias("b"), F.when(part < 5, "DEV_TUNE").when(part < 7, "DEV_CHECK").otherwise("HOLDOUT").alias("split"))
    targets = queue.sparkSession.createDataFrame([(str(b), s, 100) for b in range(3) for s in ("DEV_TUNE", "DEV_CHECK", "HOLDOUT")], "bucket string, split string, target int")
    return evaluation.allocation(queue, "b", "split", targets)


@query(f"""
    WITH {_BM25}, rel AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    dcg AS (SELECT item_id, sum(1 / log2(rank + 1)) AS d FROM r JOIN rel USING (item_id, doc_id) WHERE rank <= 10 GROUP BY item_id),
    best AS (SELECT item_id, sum(1 / log2(i + 1)) AS b FROM (SELECT item_id, least(count(*), 10) AS n FROM rel GROUP BY item_id), unnest(range(1, n + 1)) AS t(i) GROUP BY item_id)
    SELECT item_id, round(coalesce(d, 0) / b, 6) AS ndcg FROM best LEFT JOIN dcg USING (item_id)
""")
def retrieval_ndcg(read):
    return evaluation.ndcg(bm25_topk(read), quote_containment(read), "item_id", "doc_id")


def _filings(read):
    """Documents as parsed filings: every line a paragraph, lines with bars a table row, the first line a title."""
    lines = F.split("text", "\n", -1)
    node = F.transform(
        lines,
        lambda x, i: F.struct(
            F.when(i == 0, "section").otherwise("paragraph").alias("kind"),
            F.concat(F.lit("n"), i.cast("string")).alias("node_id"),
            F.when(i == 0, x).alias("title_text"),
            F.when(i > 0, x).alias("text"),
            F.array(F.concat(F.lit("S"), F.floor(i / 8).cast("string"))).alias("section_hierarchy"),
            F.lit(None).cast("array<array<string>>").alias("normalized_rows"),
            F.struct(F.lit("main.xml").alias("rel_path")).alias("source"),
        ),
    )
    return read("documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"), F.when(F.col("doc_id") % 2 == 0, "periodic").otherwise("exchange").alias("doc_group"), F.when(F.col("doc_id") % 11 == 0, "fallback").otherwise("structured").alias("tier"), node.alias("nodes"))


@query()
def chunk_profile(read):
    """Chunks and tokens of the three strategies, with the ratio to fixed windows."""
    filings, report = _filings(read), None
    segments = save(chunking.segments(filings), "segments")
    for config in (chunking.FIXED, chunking.SECTIONS, chunking.TREE):
        rows = chunking.chunks(filings, config, segments).filter("retrieval_eligible")
        part = rows.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.count_distinct("content_sha256").alias("n_distinct")).withColumn("strategy", F.lit(config["strategy"]))
        report = part if report is None else report.unionByName(part)
    return profile.ratio_to_baseline(report, "strategy", "n_chunks", "fixed-token")


@query(f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE doc_id % 11 <> 0),
    g AS (SELECT doc_id, i // 8 AS sec, sum(len(regexp_extract_all(line, '{_TOKEN}'))) AS n FROM l GROUP BY ALL)
    SELECT 'section-aware-flat' AS strategy, CAST(sum(CASE WHEN n <= 0 THEN 0 WHEN n <= 512 THEN 1 ELSE ceil((n - 512) / 448.0) + 1 END) AS BIGINT) AS n_chunks,
           CAST(sum(CASE WHEN n <= 512 THEN n ELSE n + 64 * ceil((n - 512) / 448.0) END) AS BIGINT) AS n_tokens, count(DISTINCT doc_id) FILTER (WHERE n > 0) AS n_documents FROM g
""")
def section_chunk_totals(read):
    rows = chunking.chunks(_filings(read), chunking.SECTIONS).filter("retrieval_eligible")
    return rows.agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.count_distinct("document_id").alias("n_documents")).select(F.lit("section-aware-flat").alias("strategy"), "n_chunks", "n_tokens", "n_documents")


@query(rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE doc_id % 11 <> 0),
    g AS (SELECT doc_id, i // 8 AS sec, sum(len(regexp_extract_all(line, '{_TOKEN}'))) AS n, string_agg(line, chr(10) ORDER BY i) AS joined, min(i) AS first FROM l WHERE regexp_matches(line, '\S') GROUP BY ALL)
    SELECT 'doc_' || doc_id AS document_id, 'S' || sec AS section, CASE WHEN n <= 512 THEN 1 ELSE CAST(ceil((n - 512) / 448.0) AS BIGINT) + 1 END AS n_chunks, CAST(CASE WHEN n <= 512 THEN n ELSE n + 64 * ceil((n - 512) / 448.0) END AS BIGINT) AS n_tokens,
           CASE WHEN n <= 512 THEN sha256(joined) END AS content_sha256, CASE WHEN n <= 512 THEN 'n' || first END AS first_node FROM g WHERE n > 0
""")
def section_chunks(read):
    """The chunks of every section of every document: how many, their tokens, and of a section in one chunk its text and first node."""
    rows = chunking.chunks(_filings(read), chunking.SECTIONS).filter("retrieval_eligible")
    per = rows.groupBy("document_id", F.array_join("section_path", ">").alias("section")).agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.min("content_sha256").alias("h"), F.min(F.col("source_spans")[0]["node_id"]).alias("node"))
    whole = F.col("n_chunks") == 1
    return per.select("document_id", "section", "n_chunks", "n_tokens", F.when(whole, F.col("h")).alias("content_sha256"), F.when(whole, F.col("node")).alias("first_node"))


@query(f"""
    WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '{_TOKEN}')) AS n FROM documents WHERE doc_id % 11 <> 0)
    SELECT 'fixed-token' AS strategy, CAST(sum(CASE WHEN n <= 0 THEN 0 WHEN n <= 512 THEN 1 ELSE ceil((n - 512) / 448.0) + 1 END) AS BIGINT) AS n_chunks, CAST(sum(CASE WHEN n <= 512 THEN n ELSE n + 64 * ceil((n - 512) / 448.0) END) AS BIGINT) AS n_tokens FROM t
""")
def fixed_chunk_totals(read):
    rows = chunking.chunks(_filings(read), chunking.FIXED).filter("retrieval_eligible")
    return rows.agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")).select(F.lit("fixed-token").alias("strategy"), "n_chunks", "n_tokens")
