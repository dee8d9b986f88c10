"""What a task holds and what moves: plans and parts of queries whose figures grew too fast."""

import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, constraints, facts, handoff, ir, ranking, retrieval
from lodestone.plans import filings
from lodestone.plans import queries as plans
from lodestone.sources import shared

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves(df):
    """How each exchange of a plan deals out its rows."""
    return re.findall(r"Exchange (\w+\(.*?\), \w+)", plan(df))


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 100)


def test_earlier_rows_stand_once_and_only_where_asked(spark, small_parts):
    df = spark.createDataFrame([(k, "c", "f", k % 3 == 0) for k in range(2000)], "k long, c string, f string, ask boolean")
    got = ranking.earlier(df, ["c"], ["f"], ["k"], 2, ["k"], F.col("ask"))
    assert got.rdd.getNumPartitions() == 20  # as many as the rows need
    by = {r["k"]: r["earlier"] for r in got.collect()}
    assert by[1] is None and [x["k"] for x in by[9]] == [7, 8]


def test_release_lock_joins_bounded_parts(spark, small_parts):
    lock = spark.range(3000).selectExpr("concat('p', id) AS path", "id AS n_bytes", "'h' AS sha256")
    there = spark.range(1, 3001).selectExpr("concat('p', id) AS path", "id + CAST(id = 5 AS long) AS n_bytes", "'h' AS sha256")
    got = constraints.release_lock(lock, there)
    assert moves(got) and all(", 30), REPARTITION_BY_NUM" in x for x in moves(got))
    assert sorted((r["rule"], r["key"]) for r in got.collect()) == [("FILE_LEFT_ONLY", "p0"), ("FILE_RIGHT_ONLY", "p3000"), ("SIZE", "p5")]


def test_facts_move_matched_rows_once(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    got = facts.facts(filings._contracts(read))
    assert len([x for x in moves(got) if "document_id" in x]) == len(moves(got)) == 1


def test_copies_of_a_queued_row_count_and_whole_rows_stay(spark):
    none = "CAST(array() AS array<string>)"
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "assignment_id string").selectExpr(
        "*", "'g' AS evaluation_group_id", "'?' AS question_draft", "'NOT_STARTED' AS gold_status", "'DEV' AS planned_split", "'PROVISIONAL_UNTIL_CHAIN_CLOSURE' AS split_lock_status", "'OPEN' AS authoring_status",
        "array('d1', 'd2') AS anchors", f"{none} AS known_chain_ids", "array('RELATION_CHAIN_CLOSURE') AS dependencies", f"{none} AS tags", "array('d1', 'd2') AS blocked",
    )
    docs = spark.createDataFrame([("d1", "PARSE_FAILED"), ("d2", "PARSE_FAILED")], "document_id string, state string")
    got = handoff.queue(rows, docs, docs)
    assert not re.search(r"Join \[_row", plan(got))
    assert sorted((r["rule"], r["key"]) for r in got.collect()) == [("ASSIGNMENT_ID_UNIQUE", "a"), ("BLOCKED_STATUS", "a"), ("BLOCKED_STATUS", "a"), ("BLOCKED_STATUS", "b"), ("BLOCKED_TAG", "a"), ("BLOCKED_TAG", "a"), ("BLOCKED_TAG", "b")]


def test_envelopes_join_bounded_parts(spark, small_parts):
    asks = spark.range(2000).selectExpr("id AS request_id", "'q' AS query_id", "'BM25' AS retrieval_method", "5 AS top_k", "'s' AS snapshot", "true AS available")
    found = spark.range(2000).selectExpr("id AS request_id", "'q' AS query_id", "'c' AS chunk_id", "1 + CAST(id = 7 AS int) AS rank", "1.0D AS score")
    got = retrieval.envelopes(asks, found, {"snapshot": "s"})
    assert {x for x in moves(got) if ", 20), REPARTITION_BY_NUM" not in x} == set()
    assert [r["request_id"] for r in got.filter("code <> 'OK'").collect()] == [7]


def test_tree_blocks_move_without_cells(spark, small_parts):
    got = plans.QUERIES["tree_blocks"](spark, SF)
    sorted_ = re.findall(r"Exchange hashpartitioning\(document_id\S+, of\S+, (\d+)\)", plan(got))
    assert sorted_ and int(sorted_[0]) > 8  # as many as the blocks need
    assert "body_rows" not in plan(ir.section_parents(ir.blocks(filings._trees(lambda n: spark.read.parquet(f"{SF}/{n}.parquet"))).select("document_id", "position", "node_id", "kind", "section_path")))


def test_segments_move_once_for_windows(spark):
    docs = plans._filings(lambda n: spark.read.parquet(f"{SF}/{n}.parquet"))
    segments = shared.save(chunking.segments(docs), "segments")
    text = [x for x in moves(chunking.chunks(docs, chunking.FIXED, segments)) if "e_doc" not in x and "a_doc" not in x]
    assert len([x for x in text if "REPARTITION_BY_NUM" in x]) == 1 and len(text) <= 2  # the other one is of what is known of documents


def test_problems_read_texts_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(chunking, "save", lambda df, name: kept.append(df.columns) or shared.save(df, name))
    docs = plans._filings(lambda n: spark.read.parquet(f"{SF}/{n}.parquet"))
    assert chunking.problems(chunking.chunks(docs, chunking.TREE)).count() == 0
    assert len(kept) == 1 and "raw_text" not in kept[0] and "embed_text" not in kept[0]


def test_dense_blocks_meet_a_few_queries_at_once(spark):
    x = np.random.default_rng(1).normal(size=(2048, 50))
    block = np.arange(2048), np.full(2048, 50, np.int32), x.ravel()
    tracemalloc.start()
    try:
        q, score, c = retrieval._nearest(block, block, 5, 6)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40_000_000  # all scores of two blocks are 34 MB, and there are several such arrays
    cosines = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    np.fill_diagonal(cosines, -3)
    assert (c.reshape(-1, 5) == np.sort(np.argsort(-cosines, axis=1)[:, :5], axis=1)).all()


def test_dense_batches_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    plans.QUERIES["dense_topk"](spark, SF)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == retrieval.BATCH_BYTES
