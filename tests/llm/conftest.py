import pytest

LONG = "long text of words " * 4000


@pytest.fixture(scope="session")
def docs(spark):
    """Real documents of the smallest table with every odd row: nulls, empty and very long texts, copies, and columns
    whose names the operators use themselves."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in real.limit(120).collect()]
    base = rows[0][1]
    near = base.split(" ")
    near[len(near) // 2] = "changedword"
    rows += [
        (1000, None, "en", "src0"),
        (1001, "", None, None),
        (1002, " \n\t ", "en", None),
        (1003, base, "en", "src1"),
        (1004, " ".join(near), "en", "src1"),
        (1005, LONG, "en", "src2"),
        (1005, LONG, "en", "src2"),
        (1006, "1234 5678 !!! ???", None, "src2"),
        (1007, "one two", None, "src3"),
        (1008, "One  TWO", None, "src3"),
        (None, "a document without a number, which stands here alone with a few words of its own", "en", "src3"),
        (None, None, None, None),
        (1009, "é è ü ß ñ 日本語 😀 a", "fr", "src3"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = df.selectExpr("*", "1 AS h", "2 AS row", "'x' AS k", "3 AS core", "4 AS cls", "'y' AS size", "5 AS label", "6 AS n", "7 AS _of")
    return extra.repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
