"""Sources and sinks, all through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD = "_corrupt_record"


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_with_rejects(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and (raw) of the malformed ones. Lines are read as text, so a query over rejects alone works too."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    wide = StructType([*schema.fields, StructField(BAD, StringType())])
    rows = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    bad = F.col(f"r.{BAD}").isNotNull() | F.col("r").isNull()
    return rows.filter(~bad).select(*(f"r.{f.name}" for f in schema.fields)), rows.filter(bad).select(F.col("value").alias("raw"))


def json_any(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON document or array (.json), or JSON lines (any other ending)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", path.endswith(".json")).json(path)


def csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, newlines inside quotes; codes stay text, a BOM is dropped."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def jsonl_directory(spark: SparkSession, path: str, schema: StructType, per_file: int | None = None, most: int | None = None) -> DataFrame:
    """All *.jsonl of a directory with their file's name; ``per_file`` keeps the first lines of each file, ``most`` the first
    lines of all files in the order of their names. Spark splits files at line ends."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(path).withColumn("file", F.input_file_name())
    if per_file is not None:
        # a file's blocks are numbered from its start, so lines of an earlier block come first
        rows = rows.withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_at", F.monotonically_increasing_id())
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("_block", "_at"))).filter(F.col("_n") <= per_file).drop("_block", "_at", "_n")
    if most is not None:
        if per_file is None:
            rows = rows.withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_at", F.monotonically_increasing_id())
            rows = rows.orderBy("file", "_block", "_at").limit(most).drop("_block", "_at")
        else:
            rows = rows.orderBy("file").limit(most)
    return rows


def lookup(df: DataFrame, key: str, value: str, remap: dict[str, str] | None = None) -> DataFrame:
    """The rows of one id, which reaches a Parquet scan as a filter; ``remap`` names ids of older snapshots."""
    return df.filter(F.col(key) == F.lit((remap or {}).get(value, value)))


def raw_tree(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def inventory(files: DataFrame) -> DataFrame:
    """(path, n_bytes, n_lines, sha256) of each file of raw_tree()."""
    text = F.decode("content", "ISO-8859-1")  # a character a byte
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return files.select("path", F.length("content").cast("long").alias("n_bytes"), lines.cast("long").alias("n_lines"), F.sha2("content", 256).alias("sha256"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_lines").alias("n_lines"))


def document_index(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(group, company, documents, n_documents, n_files) of files (path, doc_id, n_bytes) over a manifest, newest first."""
    per = files.groupBy("doc_id").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
    rows = manifest.join(per, "doc_id", "left")
    listed = F.sort_array(F.collect_list(F.struct("receipt_date", "doc_id", "report_name", F.coalesce("n_files", F.lit(0)).alias("n_files"))), asc=False)
    return rows.groupBy("doc_group", "corp_name").agg(listed.alias("documents"), F.count("*").alias("n_documents"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, one folder for each value of ``by``; rows are dealt by it first so that folders hold few files."""
    out = df.repartition(*by) if by else df
    (out.write.partitionBy(*by) if by else out.write).mode("errorifexists").parquet(path)


def representatives(rows: DataFrame, reasons: list[tuple[str, object]], key: str, order: list) -> DataFrame:
    """One row for each reason (name, condition): the first one that no reason before it has taken."""
    taken, out = None, None
    for name, condition in reasons:
        free = rows.filter(condition)
        free = free if taken is None else free.join(taken, key, "left_anti")
        one = free.orderBy(*order).limit(1).withColumn("reason", F.lit(name))
        out = one if out is None else out.unionByName(one)
        taken = out.select(key)
    return out
