"""The usage log as a stream. An extension: the batch operators of ledger.py give the same answers over a whole log."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """``events`` with a watermark; times without a zone are in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def deduplicated(events: DataFrame, time: str = "ts", key: str = "usage_event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, as long as its copies come within ``late`` of each other; state is dropped behind the watermark."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark([key])


def windowed_usage(events: DataFrame, by: list[str], time: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, by, n_events, total) in tumbling windows; late rows within the watermark still count."""
    counts = _timed(events, time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), *by, "n_events", "total")


def sessions(events: DataFrame, by: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(by, session_start, session_end, n_events): runs of events that are at most ``gap`` apart."""
    counts = _timed(events, time, late).groupBy(by, F.session_window(time, gap)).agg(F.count("*").alias("n_events"))
    return counts.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events")


#: What the ledger's state gives for each event: its link to the event before it in its chain, and whether its step is legal.
LINKED = "chain string, event_id long, ts timestamp, status string, before string, legal boolean, previous_log_hash string, event_hash string"
_PENDING = "ts timestamp, event_id long, status string"


class LedgerState(StatefulProcessor):
    """Events of a chain in the order of (ts, event_id), however they arrive: each is linked to the one before it by hash,
    and its step checked against the allowed ones.

    State: the head of the chain (one row), and the events that are ahead of the watermark (a list, with one timer for
    their earliest time). An event is given out once the watermark has passed it, so its place is final. A chain can go
    on from an initial state: (chain, head hash, last status).
    """

    def __init__(self, allowed: tuple[tuple[str, str], ...]) -> None:
        self.allowed = set(allowed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "hash string, status string")
        self.pending = handle.getListState("pending", _PENDING)

    def handleInitialState(self, key: tuple[str, ...], initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        for row in initialState.itertuples():
            self.head.update((row.head, row.status))

    def _wait(self, rows: list[tuple]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if rows:
            self.pending.put(rows)
            self.handle.registerTimer(int(min(r[0] for r in rows).timestamp() * 1000))
        else:
            self.pending.clear()

    def handleInputRows(self, key: tuple[str, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(t.to_pydatetime(), int(i), s) for df in rows for t, i, s in zip(df["ts"], df["event_id"], df["status"], strict=True)]
        self._wait([*((r[0], r[1], r[2]) for r in self.pending.get()), *new])
        return iter(())

    def handleExpiredTimer(self, key: tuple[str, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = [(r[0], r[1], r[2]) for r in self.pending.get()]
        due = sorted(r for r in rows if r[0].timestamp() * 1000 <= mark)
        head, status = self.head.get() if self.head.exists() else (None, None)
        out = []
        for ts, event_id, new in due:
            own = chained_hash(head, key[0], event_id, new)
            out.append((key[0], event_id, ts, new, status, status is None or (status, new) in self.allowed, head, own))
            head, status = own, new
        if due:
            self.head.update((head, status))
        self._wait([r for r in rows if r[0].timestamp() * 1000 > mark])
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINKED.split(", ")])

    def close(self) -> None:
        pass


def chained_hash(head: str | None, chain: str, event_id: int, status: str) -> str:
    return sha256("\0".join([head or "", chain, str(event_id), status]).encode()).hexdigest()


def linked(events: DataFrame, allowed: tuple[tuple[str, str], ...], late: str = "1 hour", heads: DataFrame | None = None) -> DataFrame:
    """A stream of (chain, event_id, ts, status) as LINKED rows, each event once and in its chain's order.

    heads: (chain, head, status) that the chains go on from. State is kept by RocksDB, so it need not fit in memory;
    what is written with a checkpoint to a sink of files is exactly once, also after a restart.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = _timed(events, "ts", late).groupBy("chain")
    start = heads.groupBy("chain") if heads is not None else None
    return timed.transformWithStateInPandas(LedgerState(allowed), LINKED, "Append", "EventTime", start)


class RunBudget(StatefulProcessor):
    """The runs of a split beyond its budget; state: the runs within it, a few names."""

    def __init__(self, budgets: dict[str, int]) -> None:
        self.budgets = budgets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "run string", "seen boolean")

    def handleInputRows(self, key: tuple[str, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        budget = self.budgets.get(key[0])
        runs = pd.concat(list(rows)).sort_values(["ts", "event_id"])["run"].drop_duplicates()
        known = sum(1 for _ in self.runs.keys())
        over = []
        for run in runs if budget is not None else ():
            if self.runs.containsKey((run,)):
                continue
            if known < budget:
                self.runs.updateValue((run,), (True,))
                known += 1
            else:
                over.append((key[0], run, budget))
        if over:
            yield pd.DataFrame(over, columns=["split", "run", "budget"])

    def close(self) -> None:
        pass


def over_budget(events: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """A stream of (split, run, ts, event_id) as (split, run, budget) of runs beyond their split's budget, in order of arrival.

    Events of a run that were seen before are dropped before they meet their split's few rows, so a split with a third of
    all events sends one row a run.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    firsts = events.dropDuplicates(["split", "run"])
    return firsts.groupBy("split").transformWithStateInPandas(RunBudget(budgets), "split string, run string, budget int", "Append", "None")
