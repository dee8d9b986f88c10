"""Tables in the shared folder."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodestone.sources import shared


def test_writes_side_by_side_leave_the_setting_as_it_was(spark):
    before = spark.conf.get(shared._CLEANUP, "false")
    rows = spark.range(100).repartition(4).groupBy((F.col("id") % 7).alias("k")).count()
    with ThreadPoolExecutor(6) as pool:
        tables = list(pool.map(lambda i: shared.save(rows.withColumn("i", F.lit(i)), "t"), range(12)))
    assert [t.agg(F.sum("count"), F.max("i")).first()[:] for t in tables] == [(100, i) for i in range(12)]
    assert spark.conf.get(shared._CLEANUP, "false") == before and not shared._WRITERS
    with pytest.raises(Exception, match="(?i)divi"):
        shared.save(spark.range(1).select(F.raise_error(F.lit("division"))), "bad")
    assert spark.conf.get(shared._CLEANUP, "false") == before
    shared.drop(tables[0])
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        tables[0].count()
