"""The usage ledger: the gate, whole logs, long chains, the writer, and the log as a stream."""

import datetime
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ledger
from lodestone.streaming import ledger as stream

EVENTS = "/root/testdata/sf0.001/events.parquet"
SHA = "c" * 64
LOG = [("u1", "a_tuned", "r1", "DEV_TUNE", "TUNING", "FLOW_SELECTION", SHA, "g", 1), ("u2", "a_check", "r2", "DEV_CHECK", "CHECKPOINT", "CRITICAL_REGRESSION_CHECK", SHA, "g", 2), ("u3", "a_check", "r3", "DEV_CHECK", "CHECKPOINT", "CRITICAL_REGRESSION_CHECK", SHA, "g", 3), ("u4", "a_hold", "r4", "HOLDOUT", "FINAL_HOLDOUT", "FINAL_HOLDOUT_EVALUATION", SHA, "g", 4)]
LIFE = [("a_tuned", "DEV_CHECK", "LOCKED_BY_CHAIN", "SEALED"), ("a_check", "DEV_CHECK", "LOCKED_BY_CHAIN", "SEALED"), ("a_new", "DEV_TUNE", "LOCKED_BY_COVERAGE", "SEALED"), ("a_open", "HOLDOUT", "LOCKED_BY_CHAIN", "OPENED"), ("a_sealed", "HOLDOUT", "LOCKED_BY_CHAIN", "SEALED"), ("a_done", "HOLDOUT", "LOCKED_BY_CHAIN", "CONSUMED"), ("a_diag", "HOLDOUT", "LOCKED_BY_CHAIN", "DIAGNOSTIC_ONLY"), ("a_prov", "DEV_TUNE", "PROVISIONAL_UNTIL_CHAIN_CLOSURE", "SEALED"), ("a_hold", "DEV_TUNE", "LOCKED_BY_CHAIN", "SEALED"), ("a_lost", "HOLDOUT", "LOCKED_BY_CHAIN", None), ("a_odd", "OTHER", "LOCKED_BY_CHAIN", None)]
CHECK, FINAL, TUNE = ("DEV_CHECK", "CHECKPOINT", "CRITICAL_REGRESSION_CHECK"), ("HOLDOUT", "FINAL_HOLDOUT", "FINAL_HOLDOUT_EVALUATION"), ("DEV_TUNE", "TUNING", "FLOW_SELECTION")
DIAGNOSTIC = ("HOLDOUT", "FINAL_HOLDOUT", "DIAGNOSTIC_ONLY")
ASKED = [
    ("a_new", "r9", TUNE, SHA, "OK"), ("", "r9", TUNE, SHA, "INVALID_USAGE_INPUT"), ("a_new", None, TUNE, SHA, "INVALID_USAGE_INPUT"), ("a_new", "r9", ("DEV_TUNE", "CHECKPOINT", "FLOW_SELECTION"), SHA, "INVALID_USAGE_INPUT"), ("a_none", "r9", TUNE, SHA, "INVALID_USAGE_INPUT"),
    ("a_prov", "r9", TUNE, SHA, "PROVISIONAL_SPLIT_FORBIDS_OFFICIAL_USE"), ("a_prov", "r9", ("SANDBOX", "SANDBOX", "SANDBOX_EXPLORATION"), SHA, "OK"), ("a_new", "r9", CHECK, SHA, "ASSIGNED_SPLIT_MISMATCH"), ("a_tuned", "r9", CHECK, SHA, "TUNING_LOCKED_ASSIGNMENT_CANNOT_BE_PROMOTED"),
    ("a_hold", "r9", TUNE, SHA, "ASSIGNMENT_SPLIT_HISTORY_MISMATCH"), ("a_check", "r2", CHECK, SHA, "DUPLICATE_RUN_ASSIGNMENT"), ("a_new", "r1", TUNE, "d" * 64, "RUN_IDENTITY_MISMATCH"), ("a_check", "r9", (*CHECK[:2], None), SHA, "RUN_PURPOSE_REQUIRED"),
    ("a_check", "r9", (*CHECK[:2], "FLOW_SELECTION"), SHA, "RUN_PURPOSE_SPLIT_MISMATCH"), ("a_check", "r9", CHECK, "x", "CANDIDATE_HASH_REQUIRED"), ("a_check", "r9", CHECK, SHA, "DEV_CHECK_BUDGET_EXHAUSTED"), ("a_sealed", "r9", FINAL, SHA, "HOLDOUT_SEALED"),
    ("a_done", "r9", FINAL, SHA, "HOLDOUT_ALREADY_CONSUMED"), ("a_open", "r9", FINAL, SHA, "HOLDOUT_FINAL_BUDGET_EXHAUSTED"), ("a_open", "r4", FINAL, SHA, "OK"), ("a_done", "r9", DIAGNOSTIC, SHA, "HOLDOUT_DIAGNOSTIC_REQUIRES_DIAGNOSTIC_ONLY_STATE"), ("a_diag", "r9", DIAGNOSTIC, SHA, "OK"),
    ("a_lost", "r9", FINAL, SHA, "INVALID_USAGE_INPUT"), ("a_odd", "r9", TUNE, SHA, "INVALID_USAGE_INPUT"),
]
NAMES = "assignment_id string, run_id string, executed_split string, usage_kind string, run_purpose string, configuration_sha256 string, git_commit string"


def log_of(spark):
    return spark.createDataFrame(LOG, f"usage_event_id string, {NAMES}, seq int")


def life_of(spark):
    return spark.createDataFrame(LIFE, "assignment_id string, assigned_split string, split_lock_status string, holdout_lifecycle_status string")


def test_gate(spark):
    asked = spark.createDataFrame([(k, a, r, *how, c, "g") for k, (a, r, how, c, _) in enumerate(ASKED)], f"request_id int, {NAMES}")
    got = {r["request_id"]: r["code"] for r in ledger.gates(asked, log_of(spark), life_of(spark)).collect()}
    assert got == {k: x[-1] for k, x in enumerate(ASKED)}
    corrupt = {r["code"] for r in ledger.gates(asked, log_of(spark), life_of(spark), corrupt=True).collect()}
    assert corrupt == {"LEDGER_CORRUPT", "INVALID_USAGE_INPUT"}
    other = ledger.gates(asked.withColumn("lifecycle_of", F.lit("a_open")), log_of(spark), life_of(spark)).collect()
    assert all((r["code"] == "LIFECYCLE_ASSIGNMENT_MISMATCH") == (ASKED[r["request_id"]][0] not in ("", "a_open") and r["request_id"] not in (2, 3)) for r in other)


LOCKED = {"assignment_id": "a", "split_lock_status": "LOCKED_BY_CHAIN", "assigned_split": "DEV_CHECK", "holdout_lifecycle_status": "SEALED"}
EVENT = {"run_id": "r1", "assignment_id": "a", "executed_split": "DEV_CHECK", "usage_kind": "CHECKPOINT", "run_purpose": "CRITICAL_REGRESSION_CHECK", "run_outcome": "SUCCESS", "configuration_sha256": SHA, "used_at": "2024-01-01T00:00:00Z"}


def test_writer(tmp_path, spark):
    log = ledger.Ledger(spark, str(tmp_path / "log"))
    first = log.append(EVENT, LOCKED)
    assert first["previous_log_hash"] is None and first["seq"] == 0
    for change, code in (({}, "DUPLICATE_RUN_ASSIGNMENT"), ({"executed_split": "HOLDOUT", "usage_kind": "FINAL_HOLDOUT"}, "ASSIGNED_SPLIT_MISMATCH"), ({"run_id": "r2", "configuration_sha256": None}, "CANDIDATE_HASH_REQUIRED"), ({"run_id": "r2", "run_outcome": "MAYBE"}, "INVALID_USAGE_INPUT")):
        with pytest.raises(PermissionError, match=code):
            log.append(EVENT | change, LOCKED)
    with pytest.raises(PermissionError, match="LIFECYCLE_ASSIGNMENT_MISMATCH"):
        log.append(EVENT, LOCKED | {"assignment_id": "b"})
    second = log.append(EVENT | {"run_id": "r2", "used_at": "2024-01-02T00:00:00Z"}, LOCKED)
    assert second["previous_log_hash"] == first["event_hash"]
    with pytest.raises(PermissionError, match="DEV_CHECK_BUDGET_EXHAUSTED"):
        log.append(EVENT | {"run_id": "r3"}, LOCKED)
    events = log.events()
    assert ledger.log_problems(events).count() == 0
    assert ledger.over_budget(events, "executed_split", "run_id", ["seq"]).count() == 0
    forged = ledger.log_problems(events.withColumn("notes", F.lit("forged"))).collect()
    assert {(r["rule"], r["key"]) for r in forged} == {("CONTENT_HASH", e["usage_event_id"]) for e in (first, second)}
    (tmp_path / "log" / "000000000000").rename(tmp_path / "log.gone")  # an event is missing: the chain is broken
    with pytest.raises(PermissionError, match="LEDGER_CORRUPT"):
        log.append(EVENT | {"run_id": "r2", "assignment_id": "b"}, LOCKED | {"assignment_id": "b"})


def test_whole_log(spark):
    names = "usage_event_id string, seq int, assignment_id string, run_id string, executed_split string, configuration_sha256 string, previous_log_hash string"
    rows = [("u0", 0, "a", "r", "DEV_CHECK", SHA, None), ("u0", 1, "a", "r", "DEV_CHECK", "d" * 64, "x"), ("u2", 2, "a", "q", "HOLDOUT", None, None)]
    log = spark.createDataFrame(rows, names).withColumn("usage_kind", F.when(F.col("executed_split") == "HOLDOUT", "FINAL_HOLDOUT").otherwise("CHECKPOINT"))
    log = log.withColumn("run_purpose", F.lit("CRITICAL_REGRESSION_CHECK")).withColumn("run_outcome", F.lit("SUCCESS")).withColumn("git_commit", F.lit(None).cast("string"))
    log = log.withColumn("split_lock_status_at_use", F.lit("LOCKED_BY_CHAIN")).withColumn("assigned_split_at_use", F.col("executed_split")).withColumn("holdout_lifecycle_status_at_use", F.lit("OPENED")).withColumn("chain_ids_at_use", F.array(F.lit("c")))
    log = log.withColumn("event_hash", F.lit(None).cast("string"))
    log = log.withColumn("event_hash", ledger.event_hash(log.columns))
    found = {(r["rule"], r["key"]) for r in ledger.log_problems(log).collect()}
    assert found == {("EVENT_ID_REPEATS", "u0"), ("RUN_ASSIGNMENT_REPEATS", "r/a"), ("RUN_IDENTITY", "r"), ("ASSIGNMENT_SPLITS", "a"), ("CHAIN", "u0"), ("CHAIN", "u2"), ("PREVIOUS_HASH", "u0"), ("PURPOSE_OF_SPLIT", "u2")}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_long_chain_is_checked_in_ranges(spark, parts):
    n = 500
    rows = [(i, f"h{i}", None if i == 0 else "lost" if i in (100, 101, 499) else f"h{i - 1}") for i in range(n)]
    log = spark.createDataFrame(rows, "seq int, own string, previous string").repartition(5)
    bad = ledger.long_chain_breaks(log, ["seq"], "previous", "own", parts)
    assert sorted((r["seq"], r["expected"]) for r in bad.collect()) == [(100, "h99"), (101, "h100"), (499, "h498")]
    assert {tuple(r) for r in ledger.chain_breaks(log, [], ["seq"], "previous", "own").collect()} == {tuple(r) for r in bad.select("seq", "own", "previous", "expected").collect()}
    assert ledger.long_chain_breaks(log.limit(0), ["seq"], "previous", "own").count() == 0


STEPS = (("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "view"))


def plain_links(rows, heads=None):
    out, head = [], {k: tuple(v) for k, v in (heads or {}).items()}
    for ts, event_id, chain, status in sorted(rows):
        before, last = head.get(chain, (None, None))
        own = stream.chained_hash(before, chain, event_id, status)
        out.append((chain, event_id, status, last, last is None or (last, status) in STEPS, before, own))
        head[chain] = (own, status)
    return sorted(out), head


def run_stream(spark, source, sink, check, build):
    q = build(spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").start(sink)
    q.processAllAvailable()
    q.stop()


def test_stream_equals_batch_also_after_a_restart(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    events = spark.read.parquet(EVENTS).select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("chain"), "event_id", F.date_trunc("millisecond", "ts").alias("ts"), F.col("event_type").alias("status"))
    half = events.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    end = lambda at: spark.createDataFrame([("end", -1, at, "end")], events.schema)  # noqa: E731  (moves the watermark beyond all events)
    build = lambda s: stream.linked(s, STEPS, "20 days")
    # a late part comes after the first one, within the watermark
    early = events.filter(F.col("ts") <= half)
    for part in (early.filter("event_id % 3 <> 0"), early.filter("event_id % 3 = 0")):
        part.coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, sink, check, build)
    so_far = spark.read.parquet(sink).count() if list((tmp_path / "out").glob("*.parquet")) else 0
    assert so_far < early.count()
    events.filter(F.col("ts") > half).coalesce(1).write.mode("append").parquet(source)
    for days in (400, 800):
        end(half + datetime.timedelta(days=days)).coalesce(1).write.mode("append").parquet(source)
        run_stream(spark, source, sink, check, build)
    got = spark.read.parquet(sink).filter("chain <> 'end'").collect()
    want, _ = plain_links([(r["ts"], r["event_id"], r["chain"], r["status"]) for r in events.collect()])
    assert sorted((r["chain"], r["event_id"], r["status"], r["before"], r["legal"], r["previous_log_hash"], r["event_hash"]) for r in got) == want
    illegal = ledger.illegal_steps(events, "chain", ["ts", "event_id"], "status", STEPS).select("event_id")
    assert sorted(r["event_id"] for r in got if not r["legal"]) == sorted(r[0] for r in illegal.collect())
    table = spark.read.parquet(sink)
    assert ledger.chain_breaks(table, ["chain"], ["ts", "event_id"], "previous_log_hash", "event_hash").count() == 0


def test_chains_go_on_from_an_initial_state(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    at = datetime.datetime(2024, 1, 1)
    rows = [("a", 1, at, "click"), ("b", 2, at, "view"), ("a", 3, at + datetime.timedelta(minutes=1), "purchase")]
    for part in (rows, [("end", -1, at + datetime.timedelta(days=9), "end")], [("end", -2, at + datetime.timedelta(days=19), "end")]):
        spark.createDataFrame(part, "chain string, event_id long, ts timestamp, status string").coalesce(1).write.mode("append").parquet(source)
    heads = spark.createDataFrame([("a", "h" * 64, "view")], "chain string, head string, status string")
    run_stream(spark, source, sink, check, lambda s: stream.linked(s, STEPS, "1 hour", heads))
    got = sorted((r["chain"], r["event_id"], r["status"], r["before"], r["legal"], r["previous_log_hash"], r["event_hash"]) for r in spark.read.parquet(sink).filter("chain <> 'end'").collect())
    assert got == plain_links([(t, i, c, s) for c, i, t, s in rows], {"a": ("h" * 64, "view")})[0]


def test_budgets_of_a_stream(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    events = spark.read.parquet(EVENTS).select(F.col("event_type").alias("split"), F.date_format("ts", "yyyy-MM-dd").alias("run"), "ts", "event_id")
    days = sorted(r[0] for r in events.select("run").distinct().collect())
    for part in (days[: len(days) // 2], days[len(days) // 2 :]):
        events.filter(F.col("run").isin(part)).coalesce(1).write.mode("append").parquet(source)
        run_stream(spark, source, sink, check, lambda s: stream.over_budget(s, {"click": 12, "purchase": 8}))
    got = spark.read.parquet(sink).collect()
    want = ledger.over_budget(events, "split", "run", ["ts", "event_id"], {"click": 12, "purchase": 8}).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want) and len(want) > 10


def test_windows_sessions_and_duplicates_of_a_stream(spark, tmp_path):
    rows = spark.read.parquet(EVENTS)
    sessions = stream.sessions(rows, "user_id").collect()
    per = defaultdict(list)
    for r in rows.collect():
        per[r["user_id"]].append(r["ts"])
    want = 0
    for times in per.values():
        times.sort()
        want += 1 + sum(b - a > datetime.timedelta(minutes=30) for a, b in zip(times, times[1:], strict=False))
    assert len(sessions) == want and sum(r["n_events"] for r in sessions) == rows.count()
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    twice = rows.withColumnRenamed("event_id", "usage_event_id")
    twice.union(twice).coalesce(1).write.parquet(source)
    run_stream(spark, source, sink, check, stream.deduplicated)
    assert spark.read.parquet(sink).count() == rows.count()
