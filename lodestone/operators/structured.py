"""Structured queries over facts: filters, effectivity, the envelope with its refusals, provenance and conflicts."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.values import effective
from lodestone.operators.ranking import latest

MOST = 1000


@dataclass
class StructuredQuery:
    """A closed query. An empty list does not restrict; ``scope`` OFFICIAL admits verified records only."""

    query_id: str
    corpus_snapshot_id: str
    scope: str = "OFFICIAL"
    targets: list[str] = field(default_factory=list)
    any_of: dict[str, list] = field(default_factory=dict)  # column: admitted values
    period: tuple[datetime.date, datetime.date] | None = None
    statuses: list[str] = field(default_factory=list)
    as_of: datetime.date | None = None
    limit: int = 100

    def problem(self) -> str | None:
        if not self.query_id or self.scope not in ("OFFICIAL", "SANDBOX") or not 1 <= self.limit <= MOST:
            return "INVALID_QUERY"
        if self.period and self.period[0] > self.period[1]:
            return "INVALID_QUERY"
        if self.scope == "OFFICIAL" and set(self.statuses) - {"VERIFIED"}:
            return "UNVERIFIED_DATA_FORBIDDEN"
        return None


def records(facts: DataFrame, q: StructuredQuery) -> DataFrame:
    """The records that a query admits, latest known first; all filters are plain predicates that reach the scan.

    ``facts`` has record_type, record_id, verification_status, known_at, valid_from, valid_to, period_start, period_end.
    """
    keep = F.lit(True)
    if q.targets:
        keep = keep & F.col("record_type").isin(q.targets)
    for column, values in q.any_of.items():
        if values:
            keep = keep & F.col(column).isin(values)
    if q.period:
        keep = keep & (F.col("period_start") <= q.period[1]) & (F.col("period_end") >= q.period[0])
    statuses = ["VERIFIED"] if q.scope == "OFFICIAL" else q.statuses
    if statuses:
        keep = keep & F.col("verification_status").isin(statuses)
    if q.as_of:
        keep = keep & effective(F.lit(q.as_of), F.col("known_at"), F.col("valid_from"), F.col("valid_to"))
    return facts.filter(keep).orderBy(F.col("known_at").desc(), "record_id").limit(q.limit)


def answer(facts: DataFrame | None, q: StructuredQuery, snapshot: str) -> tuple[str, DataFrame | None]:
    """(status, records): the first refusal that holds, else OK with records or NOT_FOUND without.

    No store is not the same as no data: it gives STORE_UNAVAILABLE.
    """
    if problem := q.problem():
        return problem, None
    if q.corpus_snapshot_id != snapshot:
        return "SNAPSHOT_MISMATCH", None
    if facts is None:
        return "STORE_UNAVAILABLE", None
    found = records(facts, q)
    return ("OK", found) if found.head(1) else ("NOT_FOUND", None)


#: Fields of a calculation's input that must be the stored fact's, with the code of each; checked in this order. Fixed values.
PROVENANCE = (
    ("value", "FACT_VALUE_MISMATCH"),
    ("unit", "FACT_UNIT_MISMATCH"),
    ("scope", "FACT_SCOPE_MISMATCH"),
    ("value_status", "FACT_VALUE_STATUS_MISMATCH"),
    ("known_at", "FACT_TEMPORAL_MISMATCH"),
    ("valid_from", "FACT_TEMPORAL_MISMATCH"),
    ("valid_to", "FACT_TEMPORAL_MISMATCH"),
)


def resolved(inputs: DataFrame, facts: DataFrame | None, snapshot: str, coverage_snapshot: str) -> DataFrame:
    """``inputs`` (with fact_id) and ``code``: why a fact of that id cannot be used, OK if it can; stored fields as s_*.

    facts: fact_id, the fields of PROVENANCE, verification_status, corpus_snapshot_id, fact_coverage_snapshot_id; one row an
    id, or the smallest. A fact must be of both snapshots that the request runs against. No store (None) is not the same as
    no fact.
    """
    if facts is None:
        return inputs.withColumn("code", F.lit("FACT_STORE_UNAVAILABLE"))
    rest = [c for c in facts.columns if c != "fact_id"]
    one = facts.groupBy(F.col("fact_id").alias("s_id")).agg(F.min(F.struct(*rest)).alias("s")).select("s_id", *(F.col(f"s.{c}").alias(f"s_{c}") for c in rest))
    rows = inputs.join(one, F.col("fact_id") == F.col("s_id"), "left")
    code = F.when(F.col("s_id").isNull(), "FACT_NOT_FOUND").when(~F.col("s_corpus_snapshot_id").eqNullSafe(F.lit(snapshot)), "FACT_SNAPSHOT_MISMATCH")
    return rows.withColumn("code", code.when(~F.col("s_fact_coverage_snapshot_id").eqNullSafe(F.lit(coverage_snapshot)), "FACT_COVERAGE_SNAPSHOT_MISMATCH").otherwise("OK"))


def provenance_codes(inputs: DataFrame, facts: DataFrame | None, snapshot: str, coverage_snapshot: str) -> DataFrame:
    """(request_id, code, fact_id) of every request: OK, or the first of its inputs, by position, that is not a stored fact.

    inputs: (request_id, position, fact_id and the fields of PROVENANCE). One input that fails fails its request.
    """
    rows = resolved(inputs, facts, snapshot, coverage_snapshot)
    if facts is not None:
        code = F.when(F.col("code") != "OK", F.col("code"))
        for name, of in PROVENANCE:
            code = code.when(~F.col(name).eqNullSafe(F.col(f"s_{name}")), of)
        rows = rows.withColumn("code", code.when(~F.col("s_verification_status").eqNullSafe("VERIFIED"), "UNVERIFIED_DATA_FORBIDDEN").otherwise("OK"))
    bad = F.when(F.col("code") != "OK", F.struct("position", "code", "fact_id"))
    first = rows.groupBy("request_id").agg(F.min(bad).alias("bad"))
    return first.select("request_id", F.coalesce("bad.code", F.lit("OK")).alias("code"), F.col("bad.fact_id").alias("fact_id"))


def current(facts: DataFrame, version_of: list[str], order: str) -> DataFrame:
    """The facts that no later version replaces: of each ``version_of`` the row with the largest ``order``."""
    return latest(facts, version_of, order)


def conflicts(facts: DataFrame, slot: list[str], value: str, version_of: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Slots of which the facts differ: (slot, n_facts, n_values). With ``version_of`` and ``order``, of current() facts alone."""
    if version_of and order:
        facts = current(facts, version_of, order)
    found = facts.groupBy(*slot).agg(F.count("*").alias("n_facts"), F.min(value).alias("low"), F.max(value).alias("high"), F.count_distinct(value).alias("n_values"))
    return found.filter("n_values > 1")
