"""Queries over a usage log: the events of users stand in for uses of assignments (a user is an assignment).

Columns that both dialects need are SQL text; SHA is the hash function of the dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import constraints, ledger
from lodestone.plans.queries import query

_SPLIT = "CASE user_id % 4 WHEN 0 THEN 'DEV_TUNE' WHEN 1 THEN 'DEV_CHECK' WHEN 2 THEN 'HOLDOUT' ELSE 'DEV_TUNE' END"
_LOCK = "CASE WHEN user_id % 4 = 3 THEN 'PROVISIONAL_UNTIL_CHAIN_CLOSURE' ELSE 'LOCKED_BY_CHAIN' END"
_STATE = "CASE WHEN user_id % 11 = 0 THEN 'LOST' WHEN user_id % 5 = 0 THEN 'SEALED' WHEN user_id % 5 = 1 THEN 'CONSUMED' WHEN user_id % 5 = 2 THEN 'DIAGNOSTIC_ONLY' ELSE 'OPENED' END"
_KIND = "CASE {0} WHEN 'DEV_TUNE' THEN 'TUNING' WHEN 'DEV_CHECK' THEN 'CHECKPOINT' WHEN 'HOLDOUT' THEN 'FINAL_HOLDOUT' ELSE 'SANDBOX' END"
_PURPOSE = "CASE {0} WHEN 'DEV_TUNE' THEN 'FLOW_SELECTION' WHEN 'DEV_CHECK' THEN 'CRITICAL_REGRESSION_CHECK' WHEN 'HOLDOUT' THEN 'FINAL_HOLDOUT_EVALUATION' ELSE 'SANDBOX_EXPLORATION' END"
#: The first use of each user, as its lifecycle allows it; split s.
_USED = "CASE WHEN user_id % 4 = 3 THEN 'SANDBOX' ELSE " + _SPLIT + " END"
_RUN = "concat('r_', {0}, '_', user_id % 2)"
#: What later events ask for; split s, number k.
_ASKED = f"CASE event_type WHEN 'click' THEN {_USED} WHEN 'view' THEN {_SPLIT} WHEN 'signup' THEN 'DEV_CHECK' WHEN 'purchase' THEN 'HOLDOUT' ELSE 'SANDBOX' END"
_ASKED_KIND = f"CASE WHEN k % 17 = 16 THEN 'TUNING' ELSE {_KIND.format('s')} END"
_ASKED_PURPOSE = f"CASE WHEN k % 7 = 1 THEN NULL WHEN k % 7 IN (2, 3) THEN 'DIAGNOSTIC_ONLY' WHEN k % 7 = 4 THEN 'FLOW_SELECTION' ELSE {_PURPOSE.format('s')} END"
_ASKED_RUN = f"CASE WHEN k % 5 = 0 THEN {_RUN.format('s')} WHEN k % 5 = 1 THEN 'r_HOLDOUT_0' WHEN k = 98 THEN '' ELSE concat('n', k) END"
_ASKED_HASH = "CASE WHEN k % 13 = 1 THEN 'x' ELSE {sha}({run}) END"
_LIFE_OF = "CASE WHEN k % 19 = 1 THEN concat('a', user_id + 1) WHEN k % 19 = 2 THEN 'a_none' ELSE concat('a', user_id) END"


def _usage(read) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, requests, lifecycle): the first event of each user is in the log, the others ask."""
    events = read("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    # min_by keeps one row a user; the others are told from it by id
    first = events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("at")).select("user_id", F.col("at.event_id").alias("event_id"), F.col("at.event_id").alias("seq"))
    log = first.withColumn("s", F.expr(_USED)).withColumn("run_id", F.expr(_RUN.format("s")))
    log = log.selectExpr("seq", "concat('a', user_id) AS assignment_id", "run_id", "s AS executed_split", f"{_KIND.format('s')} AS usage_kind", f"{_PURPOSE.format('s')} AS run_purpose", "sha2(run_id, 256) AS configuration_sha256", "'g' AS git_commit")
    asked = events.join(first.select("event_id"), "event_id", "left_anti").withColumn("s", F.expr(_ASKED)).withColumn("run_id", F.expr(_ASKED_RUN))
    asked = asked.selectExpr("event_id AS request_id", "concat('a', user_id) AS assignment_id", "run_id", "s AS executed_split", f"{_ASKED_KIND} AS usage_kind", f"{_ASKED_PURPOSE} AS run_purpose", f"{_ASKED_HASH.format(sha='sha2', run='run_id, 256')} AS configuration_sha256", "'g' AS git_commit", f"{_LIFE_OF} AS lifecycle_of")
    life = events.select("user_id").distinct().selectExpr("concat('a', user_id) AS assignment_id", f"{_SPLIT} AS assigned_split", f"{_LOCK} AS split_lock_status", f"{_STATE} AS holdout_lifecycle_status")
    return log, asked, life


_USAGE_SQL = f"""
    e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM e GROUP BY user_id),
    log AS (SELECT concat('a', user_id) AS a, {_RUN.format('s')} AS r, s, {_KIND.format('s')} AS kind, {_PURPOSE.format('s')} AS purpose, sha256({_RUN.format('s')}) AS sha, event_id AS seq FROM (SELECT *, {_USED} AS s FROM f)),
    asked AS (SELECT event_id AS request_id, concat('a', user_id) AS a, r, s, {_ASKED_KIND} AS kind, {_ASKED_PURPOSE} AS purpose, {_ASKED_HASH.format(sha='sha256', run='r')} AS sha, {_LIFE_OF} AS life_of
              FROM (SELECT *, {_ASKED_RUN} AS r FROM (SELECT *, {_ASKED} AS s FROM e WHERE event_id NOT IN (SELECT event_id FROM f)))),
    life AS (SELECT DISTINCT concat('a', user_id) AS l, {_SPLIT} AS assigned, {_LOCK} AS locked, {_STATE} AS state FROM events)
"""


@query(f"""
    WITH {_USAGE_SQL},
    past AS (SELECT a, max(CASE WHEN s <> 'SANDBOX' THEN s END) AS official FROM log GROUP BY a),
    runs AS (SELECT r, arg_min(s, seq) AS s, arg_min(kind, seq) AS kind, arg_min(purpose, seq) AS purpose, arg_min(sha, seq) AS sha FROM log GROUP BY r),
    j AS (
        SELECT q.*, l.*, p.official, r.r IS NULL AS fresh, r.s = q.s AND r.kind = q.kind AND r.purpose IS NOT DISTINCT FROM q.purpose AND r.sha = q.sha AS same,
               EXISTS (SELECT 1 FROM log g WHERE g.a = q.a AND g.r = q.r) AS again,
               (SELECT count(DISTINCT r) FROM log WHERE s = 'DEV_CHECK') AS checks, (SELECT count(DISTINCT r) FROM log WHERE purpose = 'FINAL_HOLDOUT_EVALUATION') AS finals
        FROM asked q LEFT JOIN life l ON q.life_of = l.l LEFT JOIN past p ON q.a = p.a LEFT JOIN runs r ON q.r = r.r
    )
    SELECT request_id, CASE
        WHEN r = '' OR kind <> {_KIND.format('s')} THEN 'INVALID_USAGE_INPUT'
        WHEN l IS NULL THEN 'INVALID_USAGE_INPUT'
        WHEN l <> a THEN 'LIFECYCLE_ASSIGNMENT_MISMATCH'
        WHEN locked LIKE 'PROV%' AND s <> 'SANDBOX' THEN 'PROVISIONAL_SPLIT_FORBIDS_OFFICIAL_USE'
        WHEN locked NOT LIKE 'PROV%' AND s <> assigned THEN 'ASSIGNED_SPLIT_MISMATCH'
        WHEN s IN ('DEV_CHECK', 'HOLDOUT') AND official = 'DEV_TUNE' THEN 'TUNING_LOCKED_ASSIGNMENT_CANNOT_BE_PROMOTED'
        WHEN s <> 'SANDBOX' AND official <> s THEN 'ASSIGNMENT_SPLIT_HISTORY_MISMATCH'
        WHEN again THEN 'DUPLICATE_RUN_ASSIGNMENT'
        WHEN NOT fresh AND NOT coalesce(same, false) THEN 'RUN_IDENTITY_MISMATCH'
        WHEN s IN ('DEV_CHECK', 'HOLDOUT') AND purpose IS NULL THEN 'RUN_PURPOSE_REQUIRED'
        WHEN s = 'DEV_CHECK' AND purpose <> 'CRITICAL_REGRESSION_CHECK' OR s = 'HOLDOUT' AND purpose NOT IN ('FINAL_HOLDOUT_EVALUATION', 'DIAGNOSTIC_ONLY') THEN 'RUN_PURPOSE_SPLIT_MISMATCH'
        WHEN s IN ('DEV_CHECK', 'HOLDOUT') AND sha = 'x' THEN 'CANDIDATE_HASH_REQUIRED'
        WHEN s = 'DEV_CHECK' AND fresh AND checks >= 2 THEN 'DEV_CHECK_BUDGET_EXHAUSTED'
        WHEN s = 'HOLDOUT' AND state = 'LOST' THEN 'INVALID_USAGE_INPUT'
        WHEN s = 'HOLDOUT' AND state = 'SEALED' THEN 'HOLDOUT_SEALED'
        WHEN s = 'HOLDOUT' AND purpose = 'FINAL_HOLDOUT_EVALUATION' AND state <> 'OPENED' THEN 'HOLDOUT_ALREADY_CONSUMED'
        WHEN s = 'HOLDOUT' AND purpose = 'FINAL_HOLDOUT_EVALUATION' AND fresh AND finals >= 1 THEN 'HOLDOUT_FINAL_BUDGET_EXHAUSTED'
        WHEN s = 'HOLDOUT' AND purpose = 'DIAGNOSTIC_ONLY' AND state <> 'DIAGNOSTIC_ONLY' THEN 'HOLDOUT_DIAGNOSTIC_REQUIRES_DIAGNOSTIC_ONLY_STATE'
        ELSE 'OK' END AS code FROM j
""")
def usage_gate(read):
    """Requests to use a split, judged against the log and the lifecycle of the assignment."""
    log, asked, life = _usage(read)
    return ledger.gates(asked, log, life)


#: An event of the log with faults: of its links, its id, its run and its shape.
_FAULTY = (
    ("usage_event_id", "CASE WHEN event_id % 101 = 3 THEN concat('u', event_id - 1) ELSE concat('u', event_id) END"),
    ("assignment_id", "concat('a', user_id)"),
    ("run_id", "CASE WHEN event_id % 89 = 5 THEN concat('r', event_id % 3) ELSE concat('r', event_id) END"),
    ("executed_split", f"CASE WHEN event_id % 97 = 1 THEN 'SANDBOX' ELSE {_USED} END"),
    ("previous_log_hash", "CASE WHEN event_id % 83 = 7 THEN {sha0} WHEN event_id = 0 THEN NULL ELSE {sha1} END"),
    ("assigned_split_at_use", _SPLIT),
    ("split_lock_status_at_use", f"CASE WHEN event_id % 79 = 2 THEN 'OPEN' ELSE {_LOCK} END"),
    ("run_outcome", "CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END"),
)


def _faulty_sql() -> str:
    shas = {"sha0": "sha256('x')", "sha1": "sha256(CAST(event_id - 1 AS VARCHAR))"}
    return "l AS (SELECT event_id AS seq, " + ", ".join(f"{e.format(**shas)} AS {c}" for c, e in _FAULTY) + f", {_KIND.format(dict(_FAULTY)['executed_split'])} AS usage_kind FROM events)"


@query(f"""
    WITH {_faulty_sql()},
    found AS (
        SELECT 'CONTENT_HASH' AS rule, count(*) AS n FROM l
        UNION ALL SELECT 'EVENT_ID_REPEATS', count(*) FROM (SELECT usage_event_id FROM l GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'RUN_ASSIGNMENT_REPEATS', count(*) FROM (SELECT run_id, assignment_id FROM l GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'RUN_IDENTITY', count(*) FROM (SELECT run_id FROM l GROUP BY 1 HAVING count(DISTINCT executed_split) > 1)
        UNION ALL SELECT 'CHAIN', count(*) FROM l WHERE previous_log_hash IS DISTINCT FROM (CASE WHEN seq > 0 THEN sha256(CAST(seq - 1 AS VARCHAR)) END)
        UNION ALL SELECT 'split_lock_status_at_use_ENUM', count(*) FROM l WHERE split_lock_status_at_use = 'OPEN'
        UNION ALL SELECT 'LOCKED', count(*) FROM l WHERE executed_split <> 'SANDBOX' AND split_lock_status_at_use = 'OPEN'
        UNION ALL SELECT 'FINAL_IS_OPENED', count(*) FROM l WHERE executed_split = 'HOLDOUT' AND seq % 73 = 0
        UNION ALL SELECT 'holdout_lifecycle_status_at_use_ENUM', count(*) FROM l WHERE seq % 73 = 0
    )
    SELECT rule, n FROM found WHERE n > 0
""")
def usage_log_problems(read):
    """A whole log of all events in one chain: its faults by rule."""
    shas = {"sha0": "sha2('x', 256)", "sha1": "sha2(CAST(event_id - 1 AS STRING), 256)"}
    log = read("events").select("event_id", "user_id", "event_type", F.col("event_id").alias("seq"), *(F.expr(e.format(**shas)).alias(c) for c, e in _FAULTY))
    log = log.withColumn("usage_kind", F.expr(_KIND.format("executed_split"))).withColumn("run_purpose", F.expr(_PURPOSE.format("executed_split"))).withColumn("holdout_lifecycle_status_at_use", F.expr("IF(seq % 73 = 0, NULL, 'OPENED')"))
    log = log.withColumn("chain_ids_at_use", F.array(F.lit("c"))).withColumn("git_commit", F.lit("g")).withColumn("configuration_sha256", F.sha2(F.lit("c"), 256)).withColumn("event_hash", F.sha2(F.col("seq").cast("string"), 256))
    return ledger.log_problems(log.drop("event_id", "user_id", "event_type")).groupBy("rule").agg(F.count("*").alias("n"))


@query("""
    WITH h AS (SELECT event_id, ts, sha256(concat(event_id, '/', event_type)) AS own, CASE WHEN event_id % 97 = 1 THEN NULL ELSE 1 END AS linked FROM events),
    l AS (SELECT event_id, own, linked, lag(own) OVER (ORDER BY ts, event_id) AS expected FROM h)
    SELECT event_id, expected FROM l WHERE linked IS NULL AND expected IS NOT NULL
""")
def one_chain(read):
    """All events as one chain, in ranges; every 97th link was lost."""
    w = Window.partitionBy(F.window("ts", "1 day")).orderBy("ts", "event_id")  # links within a day come from a window, the others from a join
    rows = read("events").select("event_id", "ts", F.sha2(F.concat_ws("/", F.col("event_id").cast("string"), "event_type"), 256).alias("own"))
    rows = rows.withColumn("before", F.lag("own").over(w)).withColumn("day", F.to_date("ts"))
    lasts = rows.groupBy("day").agg(F.max_by("own", F.struct("ts", "event_id")).alias("last"))
    days = lasts.select(F.lead("day").over(Window.orderBy("day")).alias("day"), "last")
    rows = rows.join(F.broadcast(days), "day", "left").withColumn("previous", F.when(F.col("event_id") % 97 != 1, F.coalesce("before", "last")))
    return ledger.long_chain_breaks(rows.select("event_id", "ts", "own", "previous"), ["ts", "event_id"], "previous", "own").select("event_id", "expected")


@query("""
    WITH r AS (SELECT event_type, CAST(ts AS DATE) AS run, min((ts, event_id)) AS first FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first) AS n, CASE event_type WHEN 'click' THEN 12 ELSE 8 END AS budget FROM r)
    SELECT event_type, run, budget FROM n WHERE n > budget
""")
def ledger_budget(read):
    """The days (as runs) on which a kind of event went beyond its budget of days, over the whole log."""
    return ledger.over_budget(read("events").withColumn("run", F.to_date("ts")), "event_type", "run", ["ts", "event_id"], {"click": 12, "purchase": 8})


@query(f"""
    SELECT 'assigned_split_ENUM' AS rule, concat('a', user_id) AS key FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 6 = 5
    UNION ALL SELECT 'HOLDOUT_STATE', concat('a', user_id) FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 6 <> 5 AND {_SPLIT} = 'HOLDOUT' AND user_id % 11 = 0
    UNION ALL SELECT 'NO_HOLDOUT_STATE', concat('a', user_id) FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 6 <> 5 AND {_SPLIT} <> 'HOLDOUT'
""")
def lifecycle_rules(read):
    """Lifecycle records of users, some without a known split or state."""
    users = read("events").select("user_id").distinct()
    life = users.selectExpr("concat('a', user_id) AS assignment_id", f"CASE WHEN user_id % 6 = 5 THEN NULL ELSE {_SPLIT} END AS assigned_split", f"{_LOCK} AS lock_status", f"{_STATE} AS holdout_status")
    return constraints.lifecycle(life).select("rule", "key")
