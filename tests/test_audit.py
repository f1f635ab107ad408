"""Decoys by session: order over days, repeats, missing values, and a session that a third of all events have."""

import datetime as dt

import duckdb

from larkspur import plans

KIND = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def decoys(spark, folder, rows):
    """The query's rows, which equal its SQL's."""
    events = [(e, ts, user, "view", 1.0, None if k is None else f'{{"k": {k}}}') for e, ts, user, k in rows]
    spark.createDataFrame(events, KIND).coalesce(1).write.parquet(f"{folder}/events.parquet")
    got = {r["session"]: r["decoys"] for r in plans.QUERIES["s18_audit"](spark, str(folder)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    assert got == dict(con.execute(plans.ORACLE_SQL["s18_audit"]).fetchall())
    return got


def day(n, second=0):
    return dt.datetime(2024, 1, n, 0, 0, second)


def test_decoys_in_order(spark, tmp_path):
    rows = [(9, day(2), 1, 5), (8, day(1), 1, 17), (7, day(1, 3), 1, 0), (6, day(1, 3), 1, 11), (5, day(3), 1, 1), (4, day(4), 1, 2), (3, day(4), 1, 9), (2, None, 1, 10), (1, None, 1, 7), (None, day(2), 1, 8), (10, day(2), 1, None)]
    rows += [(20, day(1), 2, 4), (21, day(1), 2, 16), (22, day(2), 2, 6)]
    rows += [(30, day(1), None, -5), (31, day(2), None, -1), (32, day(2), None, 0), (33, day(1, 1), None, 3), (34, day(1), None, 3)]
    rows += [(40, day(1), 3, None)]
    assert decoys(spark, tmp_path, rows) == {1: "5,11,5,8,9,7,10", 2: "", None: "3,3", 3: ""}


def test_a_long_session(spark, tmp_path):
    rows = [(n, day(1 + n % 28, n % 50), 7 if n % 3 == 0 else n % 1000, n * n % 100) for n in range(60_000)]
    assert len(decoys(spark, tmp_path, rows)[7].split(",")) > 5_000
