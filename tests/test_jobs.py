import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from tests.conftest import DATA

from scrubline.plans.jobs import JOBS  # noqa: E402
from scrubline.plans.oracles import ORACLES as SQL  # noqa: E402


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


def test_entry_has_all_jobs():
    assert JOBS.items() <= entry.queries().items() and SQL.items() <= entry.oracle_sql().items()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["doc_id", "text"] and len(df.columns) == 14 and df.count() == 200


def test_every_sql_has_a_job():
    assert set(SQL) == set(JOBS)


@pytest.mark.parametrize("name", ["findings_all", "redact_markup", "redact_markup_text"])
def test_job_equals_sql_on_a_larger_table(spark, name):
    larger, folder = duckdb.connect(), DATA.replace("sf0.001", "sf0.01")
    for table in TABLES:
        larger.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    line, ok = compare(spark, larger, name, folder, JOBS[name], SQL[name])
    assert ok, line


@pytest.mark.parametrize("name", JOBS)
def test_job_equals_sql(spark, con, name):
    line, ok = compare(spark, con, name, DATA, JOBS[name], SQL.get(name))
    assert ok, line
