"""Each group of cases against its SQL."""

import duckdb
import pytest

from tests.cases import CASES

SF = "/root/testdata/sf0.001"


def normal(x):
    return round(x, 6) if isinstance(x, float) else float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    run, sql = CASES[name]
    got = run(lambda table: spark.read.parquet(f"{SF}/{table}.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    want = con.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    mine = sorted(([normal(r[n]) for n in names] for r in got.collect()), key=repr)
    assert mine == sorted(([normal(v) for v in r] for r in want.project(", ".join(f'"{n}"' for n in names)).fetchall()), key=repr)
