"""Relational tables through JDBC: partitioned reads whose filters run in the database, and writes that add each row once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import schemas
from lodestone.sources.shared import save

#: Where the batches that were loaded are noted, in the database itself.
BATCHES = "loaded_batches"
_TYPES = {"string": "VARCHAR(4000)", "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "double": "DOUBLE"}


@contextmanager
def transaction(spark: SparkSession, url: str) -> Iterator[Any]:
    """A statement of one transaction on the driver: all of it happens, or nothing."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        yield connection.createStatement()
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def _rows(statement: Any, sql: str) -> list[list[Any]]:
    found, out = statement.executeQuery(sql), []
    n = found.getMetaData().getColumnCount()
    while found.next():
        out.append([found.getObject(i + 1) for i in range(n)])
    return out


def _exists(statement: Any, table: str) -> bool:
    found = statement.getConnection().getMetaData().getTables(None, None, table.upper(), None)
    return bool(found.next())


def create_table(spark: SparkSession, url: str, table: str) -> None:
    """Make a table of the data model with its keys, unique columns and references; arrays are kept as JSON text."""
    t = schemas.TABLES[table]
    lines = []
    for field in schemas.schema(table):
        kind = field.dataType.simpleString()
        lines.append(f"{field.name} {_TYPES.get(kind, kind.upper() if kind.startswith('decimal') else _TYPES['string'])}{'' if field.nullable else ' NOT NULL'}")
    lines.append(f"PRIMARY KEY ({', '.join(t.key)})")
    lines += [f"UNIQUE ({', '.join(names)})" for names in t.unique]
    lines += [f"FOREIGN KEY ({column}) REFERENCES {other} ({key})" for column, other, key in t.refers]
    with transaction(spark, url) as statement:
        statement.execute(f"CREATE TABLE {table} ({', '.join(lines)})")


def read(spark: SparkSession, url: str, table: str, by: str | None = None, parts: int = 8) -> DataFrame:
    """A table; filters and columns that the database can take are sent to it.

    by: a number, date or time column whose range is cut into ``parts`` ranges, one query each; an empty table has one.
    """
    options: dict[str, Any] = {"url": url, "dbtable": table, "pushDownPredicate": True}
    if by:
        bounds = spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({by}) AS low, MAX({by}) AS high FROM {table}").load().first()
        low, high = bounds[0], bounds[1]
        if low is not None and low != high:
            options |= {"partitionColumn": by, "lowerBound": str(low), "upperBound": str(high), "numPartitions": parts}
    return spark.read.format("jdbc").options(**options).load()


def newest(spark: SparkSession, url: str, table: str, order: list[str], n: int = 20) -> DataFrame:
    """The n rows that are last in ``order``, sorted and cut by the database: no other row is sent."""
    by = ", ".join(f"{c} DESC" for c in order)
    return spark.read.format("jdbc").options(url=url, query=f"SELECT * FROM {table} ORDER BY {by} FETCH FIRST {int(n)} ROWS ONLY").load().orderBy(*(F.col(c).desc() for c in order))


def _staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    here = TaskContext.get()
    for batch in batches:
        marks = [pa.array([x] * batch.num_rows, pa.int64()) for x in (here.partitionId(), here.taskAttemptId())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*batch.schema.names, "stage_part", "stage_try"])


def stage(df: DataFrame, url: str, staging: str) -> None:
    """Write rows to a table of their own, each with its partition and the attempt that wrote it (one transaction)."""
    flat = df.select(*(F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f.name) for f in df.schema))
    kinds = ", ".join(f"{c} {t}" for c, t in flat.dtypes)
    flat.mapInArrow(_staged, f"{kinds}, stage_part long, stage_try long").write.format("jdbc").option("url", url).option("dbtable", staging).mode("append").save()


def publish(spark: SparkSession, url: str, staging: str, table: str, columns: list[tuple[str, str]], batch: str) -> int:
    """Move what was staged into the table and note the batch, in one transaction; the number of rows added.

    columns: names and Spark's types. Of each partition the first attempt counts: an attempt that was repeated after it had committed adds nothing.
    """
    names = ", ".join(c for c, _ in columns)
    whole = ("string", "array", "map", "struct")  # what is kept as text; Spark stages it as long objects
    with transaction(spark, url) as statement:
        if not _exists(statement, BATCHES):
            statement.execute(f"CREATE TABLE {BATCHES} (batch_id VARCHAR(200) NOT NULL PRIMARY KEY, n_rows BIGINT NOT NULL)")
        known = _rows(statement, f"SELECT n_rows FROM {BATCHES} WHERE batch_id = '{batch}'")
        n = 0
        if not known and _exists(statement, staging):
            # Spark quotes the names of the tables that it makes
            own = ", ".join(f'CAST(s."{c}" AS {_TYPES["string"]})' if kind.startswith(whole) else f's."{c}"' for c, kind in columns)
            first = f'SELECT "stage_part" AS part, MIN("stage_try") AS attempt FROM {staging} GROUP BY "stage_part"'
            n = statement.executeUpdate(f'INSERT INTO {table} ({names}) SELECT {own} FROM {staging} s JOIN ({first}) f ON s."stage_part" = f.part AND s."stage_try" = f.attempt')
        if not known:
            statement.execute(f"INSERT INTO {BATCHES} VALUES ('{batch}', {n})")
        if _exists(statement, staging):
            statement.execute(f"DROP TABLE {staging}")
        return n


def append(df: DataFrame, url: str, table: str, batch: str) -> int:
    """Add rows to a table; the number added. A batch that is there already adds nothing, so a job can be run again.

    The rows are fixed in the shared folder first, so that a task that is repeated writes the same ones. Keys and checks
    of the table hold: a breach fails the transaction, and no row is added.
    """
    if "'" in batch:
        raise ValueError("a batch's name has no quotes")
    spark, staging = df.sparkSession, f"stage_{uuid.uuid4().hex[:20]}"
    stage(save(df, "rows"), url, staging)
    return publish(spark, url, staging, table, df.dtypes, batch)
