"""Queries whose users' ids are longer than the names made of them, against their SQL."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES = ["dq_id_formats", "raw_directory_to_departments", "raw_logs_to_table", "round_robin_text_ids"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    users = [3, 1500, 12340, 12341, 12349, 99991]  # three share USR1234
    kinds = ["view", "click", "purchase", "signup", "error"]
    rows = [(i, dt.datetime(2024, 1, 1 + i * 7 % 30, i % 24), users[i * i % 6 if i % 2 else i % 6], kinds[i % 5], float(i), '{"k": %d}' % (i * 13 % 97)) for i in range(200)]
    at = str(tmp_path_factory.mktemp("names"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name", QUERIES)
def test_long_ids_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{folder}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = sorted(tuple(r) for r in entry.queries()[name](spark, folder).select(*cols).collect())
    assert got == sorted(want.fetchall()) and got
