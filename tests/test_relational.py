"""The relational source and sink, over a database that runs in this process."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.sources import relational, schemas
from lodestone.sources.shared import save

ORDERS = "/root/testdata/sf0.01/orders.parquet"
URL = "jdbc:derby:memory:{};create=true"


@pytest.fixture(scope="module")
def orders(spark):
    """All orders in a database, written in one batch."""
    url = URL.format("orders")
    with relational.transaction(spark, url) as statement:
        statement.execute("CREATE TABLE orders (o_orderkey BIGINT NOT NULL PRIMARY KEY, o_custkey BIGINT, o_orderstatus VARCHAR(1), o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR(40))")
    assert relational.append(spark.read.parquet(ORDERS), url, "orders", "first") == 15000
    return url


def plan(df):
    return df._jdf.queryExecution().toString()


def lower(df):
    return df.toDF(*(c.lower() for c in df.columns))


def test_roundtrip_in_ranges(spark, orders):
    back = lower(relational.read(spark, orders, "orders", by="o_orderkey", parts=5))
    source = spark.read.parquet(ORDERS)
    assert back.rdd.getNumPartitions() == 5
    assert back.exceptAll(source).count() == 0 and source.exceptAll(back).count() == 0
    by_time = relational.read(spark, orders, "orders", by="o_orderdate", parts=3)
    assert by_time.rdd.getNumPartitions() == 3 and by_time.count() == 15000


def test_filters_and_columns_reach_the_database(spark, orders):
    df = relational.read(spark, orders, "orders", by="o_orderkey").filter("o_totalprice > 400000 and o_orderstatus = 'F'").select("o_orderkey")
    text = plan(df)
    assert "*GreaterThan(O_TOTALPRICE,400000.0), *Equal" in text and "struct<O_ORDERKEY:bigint>" in text
    want = spark.read.parquet(ORDERS).filter("o_totalprice > 400000 and o_orderstatus = 'F'").select("o_orderkey")
    assert sorted(r[0] for r in df.collect()) == sorted(r[0] for r in want.collect())


def test_newest_rows_are_cut_by_the_database(spark, orders):
    got = relational.newest(spark, orders, "orders", ["o_orderdate", "o_orderkey"], 20)
    want = spark.read.parquet(ORDERS).orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(20)
    assert [r["O_ORDERKEY"] for r in got.collect()] == [r["o_orderkey"] for r in want.collect()]
    assert "FETCH FIRST 20 ROWS ONLY" in plan(got)


def test_a_batch_counts_once(spark, orders):
    assert relational.append(spark.read.parquet(ORDERS), orders, "orders", "first") == 0
    assert relational.read(spark, orders, "orders").count() == 15000


def test_repeated_attempts_add_nothing(spark):
    url = URL.format("attempts")
    with relational.transaction(spark, url) as statement:
        statement.execute("CREATE TABLE t (id BIGINT, name VARCHAR(20))")
    rows = save(spark.range(100).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")).repartition(3, "id"), "rows")
    for _ in range(2):  # as if all tasks had committed and been run again
        relational.stage(rows, url, "staged")
    assert relational.read(spark, url, "staged").count() == 200
    assert relational.publish(spark, url, "staged", "t", rows.dtypes, "b1") == 100
    assert sorted(r[0] for r in relational.read(spark, url, "t").collect()) == list(range(100))
    assert relational.read(spark, url, "t", by="id", parts=4).agg(F.min("ID"), F.max("ID")).first()[:] == (0, 99)
    with relational.transaction(spark, url) as statement:
        assert not relational._exists(statement, "staged")
    assert relational.append(rows.limit(0), url, "t", "b2") == 0
    assert relational.read(spark, url, "t").count() == 100


def test_a_breach_adds_no_row(spark):
    url = URL.format("breach")
    for name in ("corpus_snapshots", "companies", "fact_coverage_snapshots", "experiment_runs", "evaluation_questions", "evaluation_usage_events"):
        relational.create_table(spark, url, name)
    at, sha = datetime.datetime(2024, 1, 1), "a" * 64
    row = lambda i: (f"snap{i}", sha, sha, i, at, None)
    snapshots = lambda ids: spark.createDataFrame([row(i) for i in ids], schemas.schema("corpus_snapshots"))
    assert relational.append(snapshots([1, 2]), url, "corpus_snapshots", "a") == 2
    with pytest.raises(Exception, match="duplicate key"):
        relational.append(snapshots([3, 2]), url, "corpus_snapshots", "b")
    assert relational.read(spark, url, "corpus_snapshots").count() == 2
    assert relational.append(snapshots([3]), url, "corpus_snapshots", "b") == 1  # the failed batch was not noted
    coverage = spark.createDataFrame([("cov", "nowhere", "0.2.0", "v", at, sha)], schemas.schema("fact_coverage_snapshots"))
    with pytest.raises(Exception, match="(?i)foreign key"):
        relational.append(coverage, url, "fact_coverage_snapshots", "c")


def test_usage_events_table(spark):
    at = datetime.datetime(2024, 1, 1)
    good = ("u1", None, "a1", "r1", "CHECKPOINT", "DEV_CHECK", at, "LOCKED_BY_CHAIN", ["c"], None, "b" * 64, None)
    bad = [good, ("u2", None, "a1", "r1", "CHECKPOINT", "HOLDOUT", at, "LOCKED_BY_CHAIN", [], None, None, None), ("u3", "q", "a1", "r9", "TUNING", "DEV_TUNE", at, "PROVISIONAL_UNTIL_CHAIN_CLOSURE", [], None, "x", None), ("u1", *good[1:])]
    df = spark.createDataFrame(bad, schemas.schema("evaluation_usage_events"))
    runs = spark.createDataFrame([("r1",)], "run_id string")
    found = {(r["rule"], r["key"]) for r in schemas.problems(df, "evaluation_usage_events", {"experiment_runs": runs}).collect()}
    assert {("KIND_OF_SPLIT", "u2"), ("OFFICIAL_IS_LOCKED", "u3"), ("CONFIGURATION", "u3"), ("USAGE_EVENT_ID_UNIQUE", "u1")} <= found
    assert any(key == "u3" and "RUN" in rule.upper() for rule, key in found) and not any(key == "u1" and "UNIQUE" not in rule for rule, key in found)
