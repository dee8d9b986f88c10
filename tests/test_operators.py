"""Operators on small fixtures, and every query against its SQL on the smallest tables."""

import datetime
import hashlib
import html
import os
import re
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import chunking, constraints, coverage, evaluation, facts, ir, ledger, profile, ranking, relations, responses, retrieval, structured
from lodestone.operators.components import components
from lodestone.plans import queries as plans
from lodestone.sources import readers

SF = "/root/testdata/sf0.001"
NODE = "struct<kind:string,node_id:string,title_text:string,text:string,section_hierarchy:array<string>,normalized_rows:array<array<string>>,header_row_indices:array<int>,source:struct<rel_path:string>>"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def normal(x):
    if isinstance(x, float):
        return round(x, 6)
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="module")
def answers(spark, request):
    """The rows of each query that a test asks for, a few queries at a time."""
    asked = [i.callspec.params["name"] for i in request.session.items if getattr(i, "originalname", None) == "test_query_equals_sql"]

    def run(name):
        got = plans.QUERIES[name](spark, SF)
        return got.columns, got.collect()

    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(run, name) for name in asked}


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(answers, tables, name):
    columns, rows = answers[name].result()
    want = tables.sql(plans.ORACLE_SQL[name])
    assert sorted(columns) == sorted(want.columns)
    names = sorted(columns)
    mine = sorted(([normal(r[n]) for n in names] for r in rows), key=repr)
    theirs = sorted(([normal(v) for v in r] for r in want.project(", ".join(f'"{n}"' for n in names)).fetchall()), key=repr)
    assert mine == theirs


def test_whole_pages_are_escaped(spark, tmp_path):
    page = "<p>" + "a" * 600 + '</p><a href="x">R&D</a>'
    spark.createDataFrame([(1, "http://x/?token=abc", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = plans.QUERIES["escape_and_redact"](spark, str(tmp_path)).first()
    assert got["escaped_sha256"] == hashlib.sha256(html.escape(page, quote=True).encode()).hexdigest()
    assert got["safe_url"] == "http://x/?token=[REDACTED]"


def test_whole_quotes_are_looked_for(spark, tmp_path):
    item = "the company shall pay the remaining amount by the end of the quarter"
    docs = [(1, f"first {item} last"), (2, f"{item[:45]} and nothing else"), (3, f"{item[:50]} another remainder"), (4, "nothing")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item), (8, f"{item[:45]} which no document has")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path))
    assert rows(run("quote_containment"), "item_id", "doc_id") == [(7, 1)]
    assert run("retrieval_metrics").first()["n_queries"] == 1
    assert rows(run("retrieval_ndcg"), "item_id", "ndcg") == [(7, 1.0)]


def test_every_vector_is_searched(spark, tables, tmp_path):
    got = rows(plans.QUERIES["dense_topk"](spark, SF), "query_id", "rank", "vec_id", "score")
    every = plans.ORACLE_SQL["dense_topk"].replace("WHERE vec_id < 10", "")
    want = tables.sql(f"SELECT query_id, rank, vec_id, score FROM ({every})").fetchall()
    assert [[normal(v) for v in r] for r in got] == [[normal(v) for v in r] for r in sorted(want, key=repr)]


@pytest.mark.parametrize("block", [3, 2048])
def test_dense_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    made = [(i, [float(i % 4), 1.0, float(-i)]) for i in range(12)] + [(20, None), (21, []), (22, [0.0, 0.0, 0.0]), (23, [1.0, None, 2.0]), (24, [1.0, 2.0]), (25, [2.0, 4.0]), (30, [0.0, 2.0, 0.0]), (31, [0.0, 4.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(2)
    q = v.select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = F.try_divide(dot("e", "embedding"), F.sqrt(dot("e", "e")) * F.sqrt(dot("embedding", "embedding")))
    pairs = v.join(q, F.col("vec_id") != F.col("q")).select("q", "vec_id", F.round(score, 6).alias("score"))
    want = {}
    for r in pairs.collect():
        want.setdefault(r["q"], []).append((r["score"] is None, -(r["score"] or 0.0), r["vec_id"]))
    want = sorted((k, i + 1, x[2], None if x[0] else 0.0 - x[1]) for k, xs in want.items() for i, x in enumerate(sorted(xs)[:5]))
    got = retrieval.dense(v, "vec_id", "embedding", q, "q", "e", 5).collect()
    assert sorted(((r["q"], r["rank"], r["vec_id"], r["score"]) for r in got), key=lambda r: r[:3]) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def node(kind, node_id, text=None, path=(), cells=None, header=None):
    return (kind, node_id, text if kind == "section" else None, None if kind == "section" else text, list(path), cells, header, ("a.xml",))


def document(spark, nodes, group="periodic", tier="structured"):
    return spark.createDataFrame([("d1", group, tier, nodes)], f"document_id string, doc_group string, tier string, nodes array<{NODE}>")


NODES = [node("section", "n1", "I. 개요", ["I"]), node("paragraph", "n2", "매출 1,000원", ["I"]), node("table", "n3", path=["I"], cells=[["구분", "금액"], ["매출", "10"]], header=[0])]


def test_tree_of_chunks(spark):
    out = chunking.chunks(document(spark, NODES)).orderBy("chunk_index").collect()
    assert [c["chunk_type"] for c in out] == ["SECTION_PARENT", "PARAGRAPH_CHILD", "TABLE_WHOLE", "TABLE_ROW"]
    assert out[3]["parent_chunk_id"] == out[2]["chunk_id"] and out[1]["parent_chunk_id"] == out[0]["chunk_id"]
    assert [(s["row_start"], s["row_end"]) for s in out[3]["source_spans"]] == [(0, 0), (1, 1)]
    assert out[2]["parent_chunk_id"] == out[0]["chunk_id"]  # by section path
    assert [c["retrieval_eligible"] for c in out] == [False, True, False, True]
    assert constraints.chunk_parents(chunking.chunks(document(spark, NODES))).count() == 0


def test_fallback_and_unit_rows(spark):
    out = chunking.chunks(document(spark, NODES, tier="fallback")).collect()
    assert {c["chunk_type"] for c in out} == {"DOCUMENT_FALLBACK"} and not any(c["retrieval_eligible"] for c in out)
    unit = [node("table", "t", path=["I"], cells=[["(단위 : 백만원)"]])]
    out = chunking.chunks(document(spark, unit)).collect()
    assert [(c["chunk_type"], c["index_role"], c["parent_chunk_id"] is None) for c in out] == [("TABLE_WHOLE", "CONTEXT_ONLY", True), ("TABLE_ROW", "CONTEXT_ONLY", False)]
    assert chunking.chunks(document(spark, [])).count() == 0


def test_windows_cover_every_token(spark):
    small = chunking.FIXED | {"max_tokens": 10, "overlap": 3}
    for n in (1, 9, 10, 11, 25, 100):
        text = " ".join(f"w{k}" for k in range(n))
        made = [c["raw_text"] for c in chunking.chunks(document(spark, [node("paragraph", "n", text)]), small).orderBy("chunk_index").collect()]
        got = spark.createDataFrame([(1, text)], "k int, t string")
        plan = chunking.token_windows(got, "k", "t", 10, 3).orderBy("window").collect()
        assert [" ".join(f"w{k}" for k in range(r["token_start"], r["token_end"])) for r in plan] == made
        assert set(" ".join(made).split()) == set(text.split())


def test_windows_over_several_segments(spark):
    texts = ["a b, c", "  d", "e f g h i j k", "l", "m. n (o) p"]
    nodes = [node("paragraph", f"n{k}", t, ["I"]) for k, t in enumerate(texts)]
    whole = "\n".join(texts)
    spots = [m.span() for m in re.finditer(r"\w+|[^\s\w]", whole)]
    for most, overlap in ((4, 0), (5, 2), (3, 1), (100, 10)):
        got = chunking.chunks(document(spark, nodes), chunking.FIXED | {"max_tokens": most, "overlap": overlap}).orderBy("chunk_index").collect()
        want, at = [], 0
        while True:
            end = min(len(spots), at + most)
            want.append((whole[spots[at][0] : spots[end - 1][1]], end - at))
            if end == len(spots):
                break
            at += most - overlap
        assert [(c["raw_text"], c["n_tokens"]) for c in got] == want


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_packs_are_greedy(spark, batch):
    import random

    rng = random.Random(3)
    data = [(g, k, rng.choice([0, 1, 2, 3, 5, 9, 25])) for g in range(12) for k in range(rng.choice([1, 5, 40]))]
    df = spark.createDataFrame(data, "g int, k int, n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {(r["g"], r["k"]): (r["pack"], r["pack_windows"]) for r in chunking.pack(df, ["g"], ["k"], "n", 8, 3).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for g in range(12):
        at, open_ = 0, []
        for _, k, n in (r for r in data if r[0] == g):
            if open_ and (n > 8 or sum(open_) + n > 8 or len(open_) == 3):
                at, open_ = at + 1, []
            assert got[g, k] == (at, max(1, -(-n // 8) if n > 8 else 1))
            at, open_ = (at + -(-n // 8), []) if n > 8 else (at, [*open_, n])


def test_long_rows_and_parents_over_paths(spark):
    long = " ".join(f"w{k}" for k in range(20))
    nodes = [node("section", "s1", "T", ["I"]), node("paragraph", "a", long, ["I"]), node("paragraph", "b", "x y", ["I", "A"]), node("table", "t", path=["I", "B"], cells=[[f"r{k}", str(k)] for k in range(20)])]
    small = chunking.TREE | {"parent_tokens": 12, "parent_segments": 3, "child_tokens": 8, "child_segments": 2, "row_tokens": 6, "rows": 4}
    out = chunking.chunks(document(spark, nodes, group="holding"), small).orderBy("chunk_index").collect()
    by = {c["chunk_id"]: c for c in out}
    kinds = [c["chunk_type"] for c in out]
    assert kinds == sorted(kinds, key=["HOLDING_STATUS_PARENT", "FIELD_GROUP_CHILD", "TABLE_WHOLE", "TABLE_ROW"].index)
    assert [c["raw_text"] for c in out if c["chunk_type"] == "HOLDING_STATUS_PARENT"] == ["T", " ".join(long.split()[:12]), " ".join(long.split()[12:]), "x y"]
    assert [(c["raw_text"], by[c["parent_chunk_id"]]["raw_text"][:3]) for c in out if c["chunk_type"] == "FIELD_GROUP_CHILD"] == [(" ".join(long.split()[k : k + 8]), "w0 ") for k in (0, 8, 16)] + [("x y", "x y")]
    tables = [c for c in out if c["chunk_type"] == "TABLE_WHOLE"]
    assert all(by[c["parent_chunk_id"]]["raw_text"] == "T" for c in tables)  # no chunk of its path, so the first of its file
    for c in out:
        if c["chunk_type"] == "TABLE_ROW":
            rows = {s["row_start"] for s in c["source_spans"]}
            first = next(t for t in tables if rows & {s["row_start"] for s in t["source_spans"]})
            assert c["parent_chunk_id"] == first["chunk_id"] and len(rows) <= 4
    assert constraints.chunk_parents(chunking.chunks(document(spark, nodes), small)).count() == 0


def test_embedded_text_and_eligibility(spark):
    d = document(spark, NODES).withColumns({"listed_name": F.lit(None).cast("string"), "corp_name": F.lit("가나"), "report_name": F.lit("보고서"), "warnings": F.expr("array(named_struct('code', 'b'), named_struct('code', 'a'), named_struct('code', 'b'))"), "source_files": F.expr("array(named_struct('content_format', 'pdf'))")})
    out = chunking.chunks(d).orderBy("chunk_index").collect()
    assert out[1]["embed_text"] == "기업: 가나\n문서: 보고서\n청크유형: PARAGRAPH_CHILD\n섹션: I\n\n매출 1,000원"
    assert [(c["retrieval_eligible"], c["fact_eligible"]) for c in out] == [(False, False), (True, False), (False, False), (True, False)]
    assert out[0]["warning_codes"] == ["a", "b"] and out[0]["duplicate_group_id"] == "duplicate_" + out[0]["content_sha256"][:24]
    assert chunking.chunks(document(spark, NODES)).first()["embed_text"].startswith("청크유형")
    assert chunking.mismatched_documents(d, d.limit(0)).count() == 1
    m = chunking.manifest(chunking.chunks(d)).first()
    assert (m["n_chunks"], m["n_retrieval"]) == (4, 2) and len(m["chunks_sha256"]) == 64
    total = {r["chunk_type"]: (r["n_chunks"], r["n_retrieval"], r["duplicate_rate"]) for r in chunking.corpus_profile(chunking.chunks(d)).collect()}
    assert total[None] == (4, 2, 0.0) and total["TABLE_ROW"] == (1, 1, 0.0)
    assert tuple(chunking.per_document(chunking.chunks(d)).first()) == (2, 2, 2, 2, 2)


def test_sections_are_grouped_over_the_whole_document(spark):
    nodes = [node("paragraph", "a", "one", ["I"]), node("paragraph", "b", "two", ["II"]), node("paragraph", "c", "three", ["I"])]
    out = chunking.chunks(document(spark, nodes), chunking.SECTIONS).orderBy("chunk_index").collect()
    assert [c["raw_text"] for c in out] == ["one\nthree", "two"]


def test_facts(spark):
    cells = [["1. 계약금액(원)", "-"], ["2. 계약상대방", "홍길동"], ["공시유보사유", "경영상 비밀유지"], ["유보기한", "2030.01.01"], ["계약금액", "2,000(예정)"]]
    out = {r["metric_code"]: r for r in facts.facts(document(spark, [node("table", "t", cells=cells)])).collect()}
    assert out["CONTRACT_AMOUNT"]["status"] == "DISCLOSED" and out["CONTRACT_AMOUNT"]["certainty"] == "PLANNED"
    assert out["WITHHELD_UNTIL"]["date_value"] == datetime.date(2030, 1, 1) and out["CONTRACT_COUNTERPARTY"]["text_value"] == "홍길동"
    first = {r["metric_code"]: r["status"] for r in facts.facts(document(spark, [node("table", "t", cells=cells)]), last=False).collect()}
    assert first["CONTRACT_AMOUNT"] == "WITHHELD"
    refs = facts.correction_references(document(spark, [node("table", "t", cells=[["정정대상 공시서류", "단일판매·공급계약체결"], ["정정관련 공시서류 제출일", "2023-03-05"], ["정정사유", "금액 변경"]])])).first()
    assert (refs["ref_day"], refs["ref_family"], refs["reason"]) == (datetime.date(2023, 3, 5), "단일판매공급계약", "금액 변경")


FILE, WARN = "struct<rel_path:string,content_format:string,is_attachment:boolean>", "struct<rel_path:string,code:string,severity:string,message:string>"


@pytest.mark.parametrize(
    ("tier", "warnings", "n", "files", "want"),
    [
        ("structured", [], 1, [], ("PRESENT", "PARSE_SUCCESS")),
        ("partial", [], 1, [], ("PRESENT", "PARSE_SUCCESS_WITH_WARNINGS")),
        ("fallback", [], 1, [], ("PARTIAL_PARSE_FAILURE", "FALLBACK_TEXT_ONLY")),
        ("partial", [("a", "parse_failed", "error", "m")], 0, [], ("PARSE_FAILED", "PARSE_FAILED_NO_BLOCKS")),
        ("partial", [("a", "parse_failed", "error", "No <table> found")], 0, [("a.pdf", "pdf", False), ("viewer.htm", "html", False)], ("PARSE_FAILED", "PDF_VIEWER_EMPTY_NO_TABLES")),
        ("partial", [("a", "x", "error", "m")], 1, [], ("PARTIAL_PARSE_FAILURE", "PARTIAL_PARSE_FAILURE")),
    ],
)
def test_coverage_states(spark, tier, warnings, n, files, want):
    d = spark.createDataFrame([("d", (tier,), warnings, NODES[:n], files)], f"document_id string, parse_quality struct<tier:string>, warnings array<{WARN}>, nodes array<{NODE}>, source_files array<{FILE}>")
    assert rows(ir.coverage(d), "coverage_state", "reason") == [want]
    roles = [r["role"] for r in ir.files(d).orderBy("position").collect()]
    assert roles == (["PDF_FALLBACK", "VIEWER_HTML"] if files else [])


def test_blocks_and_parents(spark):
    d = document(spark, [*NODES, node("section", "n4", "again", ["I"])])
    out = {r["node_id"]: r for r in ir.section_parents(ir.blocks(d)).collect()}
    assert out["n2"]["parent_id"] == "n4" and out["n3"]["header_rows"] == [["구분", "금액"]] and out["n3"]["body_rows"] == [["매출", "10"]]


def test_structured_answers(spark):
    day = datetime.date(2024, 1, 31)
    f = spark.createDataFrame([("FACT", "r1", "VERIFIED", datetime.datetime(2024, 1, 31), None, None, day, day), ("FACT", "r2", "CANDIDATE", datetime.datetime(2024, 1, 1), None, None, day, day)], "record_type string, record_id string, verification_status string, known_at timestamp, valid_from date, valid_to date, period_start date, period_end date")
    q = structured.StructuredQuery
    assert rows(structured.answer(f, q("1", "s", as_of=day), "s")[1], "record_id") == [("r1",)]
    assert structured.answer(f, q("1", "s", as_of=datetime.date(2024, 1, 30)), "s") == ("NOT_FOUND", None)
    assert structured.answer(f, q("1", "s", statuses=["CANDIDATE"]), "s")[0] == "UNVERIFIED_DATA_FORBIDDEN"
    assert structured.answer(f, q("1", "x"), "s")[0] == "SNAPSHOT_MISMATCH" and structured.answer(None, q("1", "s"), "s")[0] == "STORE_UNAVAILABLE"
    assert structured.answer(f, q("1", "s", limit=0), "s")[0] == "INVALID_QUERY"
    assert structured.answer(f, q("1", "s", scope="SANDBOX"), "s")[1].count() == 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 20), (5, 4), (6, 5), (7, 6), (8, 7)]
    out = dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "v", "label"))
    assert out == {**{k: 1 for k in range(1, 9)}, **{k: 10 for k in (10, 11, 12)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_retrieval_invariants(spark):
    r = spark.createDataFrame([(1, 1, 1, 0.5), (1, 2, 2, 0.7), (2, 1, 1, 0.5), (2, 1, 3, 0.4)], "q int, c int, rank int, score double")
    assert rows(retrieval.invariants(r, "q", "c", 10), "q", "code") == [(1, "SCORE_NOT_SORTED"), (2, "DUPLICATE_CHUNK"), (2, "RANK_NOT_CONTIGUOUS")]
    assert r.limit(1).select(retrieval.missing_components(F.lit("HYBRID_RRF"), F.array(F.lit("bm25"))).alias("m")).first()["m"] == ["dense", "rrf"]


def test_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    n = evaluation.numeric_match
    assert one(n(F.lit("RELATIVE"), F.lit(0.0), F.lit(0.1), F.lit(0.5))) == "FAIL"
    assert one(n(F.lit("ABSOLUTE"), F.lit(1.0), F.lit(1.1), F.lit(0.2))) == "PASS"
    assert one(n(F.lit("EXACT"), F.lit(1.0), F.lit(None).cast("double"), F.lit(0.2))) == "NOT_SCORED"
    assert one(evaluation.object_status(F.array(F.lit("PASS"), F.lit("NOT_SCORED")))) == "FAIL"
    assert one(evaluation.structured_number(F.lit(None).cast("string"), F.lit("12.5"))) == 12.5
    assert one(evaluation.structured_number(F.lit("about 12"), F.lit("12.5"))) is None
    assert one(evaluation.policy_status(F.array(F.lit("a")), F.array(F.lit("b")), F.array(F.lit("a"), F.lit("c")))) == "PASS"


def test_citations_without_stores(spark):
    c = spark.createDataFrame([("e1", "d", "f", "l", "quote")], "evidence_id string, document_id string, file_id string, locator string, quote string").withColumn("quote_sha256", F.sha2("quote", 256))
    e = c.withColumn("verification_status", F.lit("VERIFIED"))
    b = spark.createDataFrame([("d", "f", "l", "a quote here")], "document_id string, file_id string, locator string, text string")
    assert rows(evaluation.citation_codes(c, e, b), "evidence_id", "code") == [("e1", "OK")]
    assert rows(evaluation.citation_codes(c, None, b), "code") == [("EVIDENCE_STORE_UNAVAILABLE",)] and rows(evaluation.citation_codes(c, e, None), "code") == [("DOCUMENT_STORE_UNAVAILABLE",)]


def test_containing_short_and_odd_quotes(spark):
    docs = spark.createDataFrame([(1, "alpha beta, gamma delta"), (2, "beta"), (3, None), (4, "xalpha beta, gammay")], "d int, t string")
    quotes = spark.createDataFrame([(1, "alpha beta, gamma"), (2, "bet"), (3, ""), (4, None), (5, "beta gamma delta")], "q int, w string")
    want = [(q, d) for q, w in ((1, "alpha beta, gamma"), (2, "bet"), (3, ""), (5, "beta gamma delta")) for d, t in ((1, "alpha beta, gamma delta"), (2, "beta"), (4, "xalpha beta, gammay")) if w in t]
    assert sorted(rows(retrieval.containing(docs, "d", "t", quotes, "q", "w"), "q", "d")) == sorted(want)


def test_relations(spark):
    assert spark.range(1).select(relations.merged_candidates(F.lit("b"), F.array(F.lit("a"), F.lit("b"))).alias("x")).first()["x"] == ["b", "a"]
    chained = spark.createDataFrame([(1, "HOLDOUT"), (1, "DEV_TUNE"), (2, "HOLDOUT")], "chain_id int, split string")
    assert rows(relations.most_exposed(chained, "split"), "chain_id", "split") == [(1, "DEV_TUNE"), (2, "HOLDOUT")]


def test_quota_with_unique_anchors(spark):
    df = spark.createDataFrame([("x", k, [k % 2]) for k in range(6)], "bucket string, k int, anchors array<int>")
    assert ranking.quota_unique_anchors(df, "bucket", "k", "anchors", {"x": 5}, "s").count() == 2


def test_validators(spark):
    m = spark.createDataFrame([("major_20240131000001", "n", "p", "major", "00000001", None, "20240131000001", "20240131"), ("x", "", "p", "none", "1", "12", "2", "2024")], "doc_id string, report_name string, file_path string, doc_group string, corp_code string, stock_code string, rcept_no string, rcept_dt string")
    bad = constraints.manifest(m)
    assert bad.filter("key <> 'x'").count() == 0 and bad.count() == 7
    r = spark.createDataFrame([("q", '{"question":"q","retrieved_context":[],"think_trace":[],"answer":""}'), ("w", '{"question":"z","more":1}'), ("v", "no")], "question string, response string")
    assert rows(responses.problems(r, "question", "response"), "rule", "key", "message") == sorted(
        [("SCHEMA", "q", "/think_trace type"), ("SCHEMA", "v", "/ value"), ("SCHEMA", "w", "/more additionalProperties"), ("ECHO", "w", "the question is not echoed")]
        + [("SCHEMA", "w", f"/ required {n}") for n in ("answer", "retrieved_context", "think_trace")], key=repr,
    )
    lock = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "path string, n_bytes int, sha256 string")
    found = spark.createDataFrame([("a", 2, "x"), ("c", 1, "x")], "path string, n_bytes int, sha256 string")
    assert rows(constraints.release_lock(lock, found), "rule", "key") == [("FILE_LEFT_ONLY", "b"), ("FILE_RIGHT_ONLY", "c"), ("SIZE", "a")]
    assert constraints.harness_config({"gold_path": "a", "output_path": "a", "ledger_path": "b", "base_url": "c"}) == ["paths must differ"]


def test_sources(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    schema = StructType([StructField("code", StringType()), StructField("n", IntegerType())])
    (tmp_path / "a.jsonl").write_text('{"code":"001","n":1}\n\n{"code":"002","n":2}\n')
    (tmp_path / "bad.txt").write_text('{"code":"001","n":1}\nnot json\n')
    (tmp_path / "c.csv").write_text('﻿code,n\n"0,""1\nx",3\n')
    assert rows(readers.jsonl(spark, str(tmp_path / "a.jsonl"), schema), "code", "n") == [("001", 1), ("002", 2)]
    good, bad = readers.jsonl_with_rejects(spark, str(tmp_path / "bad.txt"), schema)
    assert good.count() == 1 and rows(bad, "raw") == [("not json",)]
    assert rows(readers.csv(spark, str(tmp_path / "c.csv"), schema), "code", "n") == [('0,"1\nx', 3)]
    assert readers.jsonl_directory(spark, str(tmp_path), schema, 1).count() == 1
    (tmp_path / "b.jsonl").write_text('{"code":"003","n":1}\n{"code":"004","n":2}\n')
    listed = lambda **limits: [r["code"] for r in readers.jsonl_directory(spark, str(tmp_path), schema, **limits).orderBy("code").collect()]
    assert (listed(), listed(most=3), listed(per_file=1), listed(per_file=1, most=1)) == (["001", "002", "003", "004"], ["001", "002", "003"], ["001", "003"], ["001"])
    inv = {r["path"].rsplit("/", 1)[1]: r for r in readers.inventory(readers.raw_tree(spark, str(tmp_path))).collect()}
    assert (inv["a.jsonl"]["n_bytes"], inv["a.jsonl"]["n_lines"]) == (43, 3)
    readers.write_jsonl(readers.jsonl(spark, str(tmp_path / "a.jsonl"), schema), str(tmp_path / "out"))
    assert readers.jsonl(spark, str(tmp_path / "out"), schema).count() == 2
    picked = readers.representatives(good, [("first", F.col("n") > 0), ("second", F.col("n") > 0)], "code", ["code"])
    assert rows(picked, "reason") == [("first",)]


def test_percentile_and_profile(spark):
    v = spark.createDataFrame([("a", k) for k in (5, 1, 4, 2)], "g string, x int")
    assert rows(profile.percentile_lower_grouped(v, ["g"], "x", {"p50": 0.5, "p99": 0.99}), "p50", "p99") == [(2, 4)]
    assert v.agg(profile.percentile_lower(F.collect_list("x"), 0.5).alias("p")).first()["p"] == 2
    empty = profile.duplicate_profile(v.limit(0), "x", "g").first()
    assert empty["n_rows"] == 0 and empty["duplicate_rate"] is None


def test_streaming(spark, tmp_path):
    from lodestone.streaming import ledger as stream

    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream.windowed_usage(source, ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = stream.windowed_usage(spark.read.parquet(str(tmp_path / "in")), ["event_type"])
    assert spark.sql("select sum(n_events) from usage").first()[0] == batch.agg(F.sum("n_events")).first()[0]


def test_grid_and_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "e int")
    d = spark.createDataFrame([(1, "x"), (1, "x"), (9, "y")], "e int, g string")
    assert rows(coverage.grid(a, "e", d, "g", d), "e", "g", "n_documents", "coverage_state")[0] == (1, "x", 2, "PRESENT")
    assert rows(coverage.unknown_keys(d, "e", a, "e"), "e") == [(9,)]


def test_recommendations(spark):
    docs = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", False)], "doc_id int, report_name string, is_correction boolean")
    cover = spark.createDataFrame([(1, "PRESENT", "x"), (2, "PRESENT", "x"), (3, "PARSE_FAILED", "y")], "document_id int, coverage_state string, reason string")
    refs = spark.createDataFrame([(2, "MATCHED_IN_CORPUS", [1])], "doc_id int, status string, targets array<int>")
    cands = spark.createDataFrame(
        [("r1", "AMENDS", 2, None, [3, 1]), ("r2", "TERMINATES", 1, "HIGH_CONFIDENCE_REVIEW", [2]), ("r3", "AMENDS", 3, None, []), ("r4", "TERMINATES", 1, "NO_TARGET_IN_MANIFEST_CANDIDATES", [])],
        "relation_id string, relation_type string, source_id int, identity_status string, candidates array<int>",
    )
    held = spark.createDataFrame([(2, "e2"), (2, "e1"), (1, "e3")], "document_id int, evidence_id string")
    out = relations.recommendations(cands, docs, cover, refs, held)
    assert rows(out, "relation_id", "evidence")[0] == ("r1", ["e1", "e2"])
    assert {(r["rule"], r["key"]) for r in constraints.relation(relations.recommendations(cands, docs, cover, refs)).collect()} == {("EVIDENCE", k) for k in ("r1", "r2", "r4")} and constraints.relation(out).count() == 0
    assert rows(out, "relation_id", "target_id", "n_candidates", "machine_status") == [
        ("r1", 1, 2, "READY_FOR_HUMAN_REVIEW"),
        ("r2", 2, 1, "BLOCKED_UNTIL_TARGET_AMENDS_REVIEW"),
        ("r3", None, 0, "PARSE_BLOCKED"),
        ("r4", None, 0, "NO_TARGET_CANDIDATE_REVIEW"),
    ]
    with pytest.raises(Exception, match="source document or coverage missing"):
        relations.recommendations(cands, docs.filter("doc_id <> 1"), cover, refs).collect()
    text = spark.createDataFrame([("d", 2, "계약 해지"), ("d", 1, "해지 사유"), ("d", 3, "other")], "document_id string, position int, text string")
    assert rows(relations.termination_evidence(text), "quotes") == [(["해지 사유", "계약 해지"],)]


def test_warning_policies(spark):
    d = spark.createDataFrame([("d", [("a", "parse_failed", "error", "m"), ("a", "parse_failed", "error", "m"), ("a", "new", "info", "m")])], f"document_id string, warnings array<{WARN}>")
    assert rows(ir.warning_policies(d), "code", "retrieval_policy") == [("new", None), ("parse_failed", "DENY_IF_EMPTY_OR_FALLBACK")]
