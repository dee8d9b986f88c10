"""The usage ledger: hash chain, budgets, state machines, the check of a whole log, and one gate for requests to use a split.

A log is a table of usage events in the order of ``seq``. Nothing of it is gathered: each check is a join, a window over
ranges, or an aggregate of one row a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions.vocabulary import HOLDOUT_STATES, PURPOSE_SPLITS, RUN_OUTCOMES, SPLIT_LOCKS, SPLITS, USAGE_KINDS
from lodestone.operators.constraints import usage_event
from lodestone.operators.coverage import all_of
from lodestone.sources.shared import save

#: Distinct runs that a split, or a final evaluation of the holdout, may have in the whole log.
BUDGETS = {"DEV_CHECK": 2, "HOLDOUT": 1}
#: Steps that a sealed holdout question may take.
HOLDOUT_STEPS = (("SEALED", "OPENED"), ("OPENED", "CONSUMED"), ("CONSUMED", "DIAGNOSTIC_ONLY"))


def chain_breaks(log: DataFrame, by: list[str], order: list[str], previous: str, own: str) -> DataFrame:
    """Events whose recorded previous hash is not the hash of the event before them; the first of a chain must have none."""
    before = F.lag(own).over(Window.partitionBy(*by).orderBy(*order))
    return log.withColumn("expected", before).filter(~F.col(previous).eqNullSafe(F.col("expected")))


def long_chain_breaks(log: DataFrame, order: list[str], previous: str, own: str, parts: int = 64) -> DataFrame:
    """chain_breaks() of one chain of any length: ranges of it are checked side by side.

    The log is sorted into ``parts`` ranges; each compares its own rows, and its first row with the last hash of the range
    before, which comes from one row a range. Rows that are equal in ``order`` should not occur, as a chain has one order.
    """
    dealt = log.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch.column(batch.schema.get_field_index(own)).to_pylist()
            before = pa.array([last, *hashes[:-1]], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, before, pa.array([part] * len(hashes), pa.int32()), pa.array(range(n, n + len(hashes)), pa.int64())], names=[*batch.schema.names, "expected", "_part", "_at"]
            )
            last, n = hashes[-1], n + len(hashes)

    kinds = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    rows = save(dealt.mapInArrow(marked, f"{kinds}, expected string, _part int, _at long"), "chain")
    ends = rows.groupBy("_part").agg(F.max_by(own, "_at").alias("_last"))
    # one row a range
    edges = ends.select((F.lead("_part").over(Window.orderBy("_part"))).alias("_part"), F.col("_last")).filter("_part is not null").withColumn("_at", F.lit(0).cast("long"))
    joined = rows.join(F.broadcast(edges), ["_part", "_at"], "left").withColumn("expected", F.coalesce("expected", "_last"))
    return joined.filter(~F.col(previous).eqNullSafe(F.col("expected"))).drop("_part", "_at", "_last")


def repeated_runs(log: DataFrame, run: str = "run_id", assignment: str = "assignment_id") -> DataFrame:
    """(run, assignment, n) that stand in the log more than once."""
    return log.groupBy(run, assignment).agg(F.count("*").alias("n")).filter("n > 1")


def changed_identity(log: DataFrame, fields: list[str], order: list[str], run: str = "run_id") -> DataFrame:
    """Events of a run that differ from its first event in a field."""
    w = Window.partitionBy(run).orderBy(*order)
    names = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.first(c).over(w)), F.lit(c)) for c in fields)))
    return log.withColumn("changed", names).filter(F.size("changed") > 0)


def over_budget(log: DataFrame, split: str, run: str, order: list[str], budgets: dict[str, int] = BUDGETS) -> DataFrame:
    """(split, run, nth, budget) of the runs beyond the budget of their split, in the order of their first events.

    The budget is over the whole log, whatever the assignments; further events of a run are free.
    """
    budget = F.lit(None).cast("int")
    for name, n in budgets.items():
        budget = F.when(F.col(split) == name, n).otherwise(budget)
    firsts = log.filter(F.col(split).isin(list(budgets))).groupBy(split, run).agg(F.min(F.struct(*order)).alias("_first")).withColumn("budget", budget)
    # the runs within the budget are a few rows a split (a limit before rows move); the others are told from them
    rank = F.row_number().over(Window.partitionBy(split).orderBy("_first", run))
    within = firsts.withColumn("_n", rank).filter(F.col("_n") <= max(budgets.values(), default=0)).filter("_n <= budget").select(split, run)
    return firsts.join(F.broadcast(within), [split, run], "left_anti").select(split, run, "budget")


def illegal_steps(log: DataFrame, key: str, order: list[str], status: str, allowed: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows whose status may not follow the one before them; the allowed steps are a few literals."""
    rows = log.withColumn("before", F.lag(status).over(Window.partitionBy(key).orderBy(*order)))
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("before") == a) & (F.col(status) == b))
    return rows.filter(F.col("before").isNotNull() & ~ok)


#: Fields in which all events of a run agree. Fixed values.
IDENTITY = ("executed_split", "usage_kind", "run_purpose", "configuration_sha256", "git_commit")
#: What an event's hash leaves out.
UNHASHED = ("event_hash", "seq")


def event_hash(columns: list[str]) -> Column:
    """sha256 of an event as JSON with sorted keys, its own hash left out."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns) if c not in UNHASHED)), {"ignoreNullFields": "false"}), 256)


def log_problems(log: DataFrame) -> DataFrame:
    """(rule, key, message) of what is wrong with a whole log (usage events and ``seq``, their order); no row for a sound one.

    Each event's shape and hash, event ids that repeat, assignments that repeat in a run, runs whose events differ in
    IDENTITY, assignments with several official splits, and links that are not the hash of the event before.
    """
    key = "usage_event_id"
    told = lambda df, rule, of, message: df.select(F.lit(rule).alias("rule"), of.cast("string").alias("key"), F.lit(message).alias("message"))
    ids_again = log.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    runs_again = repeated_runs(log)
    # one row a run and field, however long the run is
    first = log.groupBy("run_id").agg(*(F.min_by(F.struct(c), "seq")[c].alias(f"_{c}") for c in IDENTITY), *(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"n_{c}") for c in IDENTITY))
    mixed = first.filter(" or ".join(f"n_{c} > 1" for c in IDENTITY)).withColumn("changed", F.array_compact(F.array(*(F.when(F.col(f"n_{c}") > 1, F.lit(c)) for c in IDENTITY))))
    splits = log.filter("executed_split <> 'SANDBOX'").groupBy("assignment_id").agg(F.count_distinct("executed_split").alias("n")).filter("n > 1")
    return all_of(
        usage_event(log),
        told(log.filter(~F.col("event_hash").eqNullSafe(event_hash(log.columns))), "CONTENT_HASH", F.col(key), "the hash is not that of the event"),
        told(ids_again, "EVENT_ID_REPEATS", F.col(key), "the event id occurs more than once"),
        told(runs_again, "RUN_ASSIGNMENT_REPEATS", F.concat_ws("/", "run_id", "assignment_id"), "the assignment occurs more than once in the run"),
        mixed.select(F.lit("RUN_IDENTITY").alias("rule"), F.col("run_id").alias("key"), F.array_join("changed", ",").alias("message")),
        told(splits, "ASSIGNMENT_SPLITS", F.col("assignment_id"), "the assignment has several official splits"),
        told(long_chain_breaks(log, ["seq"], "previous_log_hash", "event_hash"), "CHAIN", F.col(key), "the link is not the hash of the event before"),
    )


def gates(requests: DataFrame, log: DataFrame, lifecycle: DataFrame, corrupt: bool = False) -> DataFrame:
    """(request_id, code) of every request to use a split: the first rule that forbids it, or OK. Each is judged by itself.

    requests: (request_id, assignment_id, run_id and IDENTITY; lifecycle_of, the assignment of the lifecycle record that
    comes with it, if it is not its own); log: usage events with these and seq, their order; lifecycle: (assignment_id,
    assigned_split, split_lock_status, holdout_lifecycle_status). corrupt: whether log_problems() found any. The log is
    reduced to one row an assignment, one a run, and one in all before it is joined.
    """
    official = F.col("executed_split") != "SANDBOX"
    used = log.groupBy(F.col("assignment_id").alias("u_id")).agg(F.array_sort(F.collect_set(F.when(official, F.col("executed_split")))).alias("splits"))  # three at most
    runs = log.groupBy(F.col("run_id").alias("r_id")).agg(F.min_by(F.struct(*IDENTITY), "seq").alias("first"))
    pairs = log.select(F.col("run_id").alias("p_run"), F.col("assignment_id").alias("p_id")).distinct().withColumn("repeated", F.lit(True))
    final = (F.col("usage_kind") == "FINAL_HOLDOUT") & (F.col("run_purpose") == "FINAL_HOLDOUT_EVALUATION")
    spent = log.agg(F.count_distinct(F.when(F.col("executed_split") == "DEV_CHECK", F.col("run_id"))).alias("n_checks"), F.count_distinct(F.when(final, F.col("run_id"))).alias("n_finals"))
    life = lifecycle.withColumnRenamed("assignment_id", "l_id")
    of = F.coalesce("lifecycle_of", "assignment_id") if "lifecycle_of" in requests.columns else F.col("assignment_id")
    rows = requests.withColumn("_of", of).join(life, F.col("_of") == F.col("l_id"), "left").join(used, F.col("assignment_id") == F.col("u_id"), "left").join(runs, F.col("run_id") == F.col("r_id"), "left")
    rows = rows.join(pairs, (F.col("run_id") == F.col("p_run")) & (F.col("assignment_id") == F.col("p_id")), "left").crossJoin(F.broadcast(spent))  # one row
    return rows.select("request_id", verdict(F.lit(corrupt)).alias("code"))


def verdict(corrupt: Column) -> Column:
    """The first rule that forbids a request, from its row in gates(); the only place that has the rules and their order."""
    official = F.col("executed_split") != "SANDBOX"
    split, purpose, state, past = F.col("executed_split"), F.col("run_purpose"), F.col("holdout_lifecycle_status"), F.coalesce("splits", F.array().cast("array<string>"))
    known = lambda c, names: F.coalesce(c.isin(list(names)), F.lit(False))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    kind_fits, purpose_fits, same = F.lit(False), F.lit(False), F.lit(True)
    for kind, of in USAGE_KINDS.items():
        kind_fits |= F.col("usage_kind").eqNullSafe(kind) & split.eqNullSafe(of)
    for name, of in PURPOSE_SPLITS.items():
        purpose_fits |= purpose.eqNullSafe(name) & known(split, of)
    for c in IDENTITY:
        same &= F.col(f"first.{c}").eqNullSafe(F.col(c))
    measured, holdout, fresh = split.isin("DEV_CHECK", "HOLDOUT"), split == "HOLDOUT", F.col("first").isNull()
    provisional, final = F.col("split_lock_status") == "PROVISIONAL_UNTIL_CHAIN_CLOSURE", purpose == "FINAL_HOLDOUT_EVALUATION"
    ladder = (
        ("INVALID_USAGE_INPUT", blank("assignment_id") | blank("run_id") | ~kind_fits),
        ("LEDGER_CORRUPT", corrupt),
        ("INVALID_USAGE_INPUT", F.col("l_id").isNull()),
        ("LIFECYCLE_ASSIGNMENT_MISMATCH", F.col("l_id") != F.col("assignment_id")),
        ("INVALID_USAGE_INPUT", ~known(F.col("assigned_split"), SPLITS) | ~known(F.col("split_lock_status"), SPLIT_LOCKS)),
        ("PROVISIONAL_SPLIT_FORBIDS_OFFICIAL_USE", provisional & official),
        ("ASSIGNED_SPLIT_MISMATCH", ~provisional & (split != F.col("assigned_split"))),
        ("TUNING_LOCKED_ASSIGNMENT_CANNOT_BE_PROMOTED", measured & F.array_contains(past, "DEV_TUNE")),
        ("ASSIGNMENT_SPLIT_HISTORY_MISMATCH", official & (F.size(past) > 0) & ~F.array_contains(past, split)),
        ("DUPLICATE_RUN_ASSIGNMENT", F.col("repeated").isNotNull()),
        ("RUN_IDENTITY_MISMATCH", ~fresh & ~same),
        ("RUN_PURPOSE_REQUIRED", measured & ~known(purpose, PURPOSE_SPLITS)),
        ("RUN_PURPOSE_SPLIT_MISMATCH", measured & ~purpose_fits),
        ("CANDIDATE_HASH_REQUIRED", measured & ~F.coalesce(F.col("configuration_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("DEV_CHECK_BUDGET_EXHAUSTED", (split == "DEV_CHECK") & fresh & (F.col("n_checks") >= BUDGETS["DEV_CHECK"])),
        ("INVALID_USAGE_INPUT", holdout & ~known(state, HOLDOUT_STATES)),
        ("HOLDOUT_SEALED", holdout & (state == "SEALED")),
        ("HOLDOUT_ALREADY_CONSUMED", holdout & final & state.isin("CONSUMED", "DIAGNOSTIC_ONLY")),
        ("HOLDOUT_NOT_OPENED_FOR_FINAL_RUN", holdout & final & (state != "OPENED")),
        ("HOLDOUT_FINAL_BUDGET_EXHAUSTED", holdout & final & fresh & (F.col("n_finals") >= BUDGETS["HOLDOUT"])),
        ("HOLDOUT_DIAGNOSTIC_REQUIRES_DIAGNOSTIC_ONLY_STATE", holdout & (purpose == "DIAGNOSTIC_ONLY") & (state != "DIAGNOSTIC_ONLY")),
    )
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in ladder), F.lit("OK"))


#: An event as the log keeps it. Fixed values.
EVENT = (
    "schema_version string, usage_event_id string, assignment_id string, question_id string, run_id string, usage_kind string, executed_split string, run_purpose string, "
    "run_outcome string, used_at string, assigned_split_at_use string, split_lock_status_at_use string, holdout_lifecycle_status_at_use string, chain_ids_at_use array<string>, "
    "git_commit string, configuration_sha256 string, notes string, previous_log_hash string, event_hash string, seq long"
)


class Ledger:
    """A log in a folder that driver and executors share: JSON lines, one file an event, each written once.

    An event is judged by the same gate as any request, against the log as it stands, which must be sound. Two writers
    cannot both write event n: the second one fails, and may ask again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENT).option("recursiveFileLookup", True).json(self.path)
        except AnalysisException:  # no event yet
            return self.spark.createDataFrame([], EVENT)

    def append(self, event: dict[str, Any], lifecycle: dict[str, Any]) -> dict[str, Any]:
        """The event as it was written; PermissionError with a code where a rule forbids it."""
        log = self.events()
        ask = self.spark.createDataFrame([tuple(event.get(c) for c in ("assignment_id", "run_id", *IDENTITY))], f"assignment_id string, run_id string, {', '.join(c + ' string' for c in IDENTITY)}")
        ask = ask.withColumn("request_id", F.lit(0)).withColumn("lifecycle_of", F.lit(lifecycle.get("assignment_id")).cast("string"))
        state = ("assignment_id", "assigned_split", "split_lock_status", "holdout_lifecycle_status")
        life = self.spark.createDataFrame([tuple(lifecycle.get(c) for c in state)], ", ".join(c + " string" for c in state)).filter("assignment_id <> ''")
        code = gates(ask, log, life, bool(log_problems(log).head(1))).first()["code"]
        if code == "OK" and event.get("run_outcome") not in RUN_OUTCOMES:
            code = "INVALID_USAGE_INPUT"
        if code != "OK":
            raise PermissionError(code)
        last = log.orderBy(F.col("seq").desc()).select("seq", "event_hash").first()
        done = {c.split()[0]: event.get(c.split()[0]) for c in EVENT.split(", ")} | {"schema_version": "0.2.0", "chain_ids_at_use": event.get("chain_ids_at_use") or []}
        done |= {f"{c}_at_use": lifecycle.get(c) for c in state[1:]} | {"previous_log_hash": last and last["event_hash"], "seq": last["seq"] + 1 if last else 0}
        row = self.spark.createDataFrame([tuple(done.values())], EVENT).withColumn("usage_event_id", ids.stable_id("usage", "assignment_id", "run_id", "used_at"))
        if log.join(row.select("usage_event_id"), "usage_event_id", "left_semi").head(1):
            raise PermissionError("DUPLICATE_USAGE_EVENT_ID")
        row = row.withColumn("event_hash", event_hash(row.columns))
        if problem := usage_event(row).first():
            raise PermissionError(f"LEDGER_INVALID_EVENT_SHAPE: {problem['message']}")
        written = row.first().asDict()
        row.coalesce(1).write.mode("error").option("ignoreNullFields", False).json(f"{self.path}/{written['seq']:012d}")
        return written
