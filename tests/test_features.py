from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vigilake.functions import scalar
from vigilake.operators import features, graph, quality

D = lambda n: date(2010, 1, n)


def logon(spark, rows):
    """rows: (user, pc, day, hour, activity)."""
    made = [(str(i), u, pc, datetime(2010, 1, d, h), D(d), a) for i, (u, pc, d, h, a) in enumerate(rows)]
    return spark.createDataFrame(made, "id string, user_id string, pc string, ts timestamp, day date, activity string")


def files(spark, rows):
    return spark.createDataFrame([(str(i), u, D(d), c) for i, (u, d, c) in enumerate(rows)], "id string, user_id string, day date, content string")


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_logon_counts(spark):
    df = logon(spark, [("A", "P1", 4, 6, "Logon"), ("A", "P1", 4, 9, "Logon"), ("A", "P2", 4, 17, "Logoff")])
    assert rows_of(features.logon_features(df), "login_count", "after_hours_login_count", "unique_device_count") == [(2, 1, 1)]
    assert rows_of(features.logon_features(df, devices_of_all=True), "unique_device_count") == [(2,)]


def test_device_and_file_counts(spark):
    df = logon(spark, [("A", "P1", 4, 6, "Connect"), ("A", "P1", 4, 9, "Disconnect")])
    assert rows_of(features.device_features(df), "usb_connection_count") == [(1,)]
    f = files(spark, [("A", 1, scalar.SENSITIVE_PREFIXES[0] + "x"), ("A", 1, scalar.SENSITIVE_PREFIXES[1]), ("A", 2, "FF-D8"), ("A", 2, None)])
    assert rows_of(features.file_features(f), "file_access_count", "sensitive_file_access_count") == [(2, 0), (2, 2)]


@pytest.mark.parametrize("window, expected", [(2, [(D(1), 1), (D(4), 1)]), (3, [(D(1), 1)])])
def test_unusual_window(spark, window, expected):
    df = logon(spark, [("A", "P1", 1, 9, "Logon"), ("A", "P1", 4, 9, "Logon")])
    for f in (features.unusual_access, features.unusual_access_join):
        assert rows_of(f(df, window), "day", "unusual_access_count") == expected


def test_grid_is_dense(spark):
    df = logon(spark, [("A", "P1", 4, 6, "Logon"), ("B", "P1", 5, 9, "Logoff")])
    none = files(spark, [])
    table = features.user_day_table({"logon": df, "device": df, "file": none, "http": none}, features.user_day_grid(df, D(4), D(5)))
    assert table.count() == 4
    assert rows_of(table.filter("user_id = 'B'"), "login_count", "http_activity_count") == [(0, 0), (0, 0)]


def test_past_set_size(spark):
    first = spark.createDataFrame([("A", "x", D(1)), ("A", "y", D(3)), ("A", "z", D(5))], "user_id string, pc string, first_day date")
    days = spark.createDataFrame([("A", D(d)) for d in (1, 2, 4, 6)], "user_id string, day date")
    assert rows_of(graph.past_set_size(first, "user_id", days), "day", "n_past") == [(D(1), 0), (D(2), 1), (D(4), 2), (D(6), 3)]


def test_jaccard(spark):
    df = spark.createDataFrame([(2, 2, 1), (1, 3, 0), (0, 5, 0)], "d int, p int, b int")
    got = [r[0] for r in df.select(scalar.jaccard(F.col("d"), F.col("p"), F.col("b"))).collect()]
    assert got == [pytest.approx(1 / 3), 0.0, 0.0]


def test_same_day_device_is_new(spark):
    df = logon(spark, [("A", "P1", 1, 9, "Logon"), ("A", "P2", 1, 9, "Logon"), ("A", "P1", 2, 9, "Logon"), ("A", "P3", 2, 9, "Logon"), ("A", "P3", 2, 10, "Logon")])
    got = graph.consistency(df, "pc", "score", rare_entities="rare").filter(F.col("day") == F.lit(D(2))).first()
    assert got["score"] == pytest.approx(1 / 3) and got["rare"] == 1


def test_future_rows_change_nothing_before(spark):
    early = [("A", "P1", 1, 9, "Logon"), ("A", "P2", 2, 9, "Logon"), ("B", "P1", 2, 20, "Logon")]
    late = early + [("A", "P1", 6, 9, "Logon"), ("B", "P9", 7, 9, "Logon")]
    cut = lambda df: rows_of(df.filter(F.col("day") <= F.lit(D(3))), *df.columns)
    for f in (features.unusual_access, lambda x: graph.consistency(x, "pc", "s", "r"), features.logon_features):
        assert cut(f(logon(spark, early))) == cut(f(logon(spark, late)))


def test_department_as_of(spark):
    shots = spark.createDataFrame([(date(2009, 12, 1), "A", "Dec"), (date(2010, 1, 1), "A", "Jan")], "snapshot_month date, user_id string, department string")
    rows = spark.createDataFrame([("A", date(2010, 1, 5)), ("A", date(2010, 2, 5)), ("A", date(2010, 3, 5))], "user_id string, day date")
    assert [r[1] for r in rows_of(graph.department_of_day(rows, shots), "day", "department")[:2]] == ["Dec", "Jan"]
    assert [r[1] for r in rows_of(graph.department_of_day(rows, shots, asof=True), "day", "department")] == ["Dec", "Jan", "Jan"]


def test_labels(spark):
    grid = spark.createDataFrame([("A", D(4)), ("A", D(5)), ("A", D(6))], "user_id string, day date")
    bad = spark.createDataFrame([("A", D(4), D(5)), ("A", D(5), D(5)), ("A", None, D(6))], "user_id string, start date, end date")
    assert [r[1] for r in rows_of(features.label_days(grid, bad), "day", "is_malicious")] == [1, 1, 0]


def test_split_order(spark):
    with pytest.raises(ValueError):
        features.split_of(F.col("day"), "2010-03-01", "2010-02-01")


def test_alignment_errors(spark):
    a = spark.createDataFrame([("A", D(1)), ("A", D(2))], "user_id string, day date")
    features.verify_alignment(a, a)
    with pytest.raises(ValueError):
        features.verify_alignment(a, a.limit(1))
    with pytest.raises(ValueError):
        features.verify_alignment(a, a.unionByName(a))


def test_quality(spark):
    rows = [("{A-1}", "01/02/2010 03:04:05"), ("{A-1}", "bad"), (None, "01/02/2010 03:04:05"), ("x", "01/03/2010 00:00:00")]
    df = spark.createDataFrame(rows, "id string, date string").withColumn("ts", scalar.parse_ts(F.col("date")))
    assert quality.timestamps(df).first()["unparseable"] == 1
    got = quality.ids(df).first()
    assert (got["duplicate_ids"], got["bad_format"]) == (1, 2)
    assert quality.numeric_range(spark.range(5), "id", 1, 3).first()[0] == 2


def test_merge_needs_every_key(spark):
    a = spark.createDataFrame([("A", D(1)), ("A", D(2))], "user_id string, day date")
    assert features.merge_columns(a, a.withColumn("x", F.lit(1)), ["x"]).count() == 2
    with pytest.raises(Exception):
        features.merge_columns(a, a.limit(1).withColumn("x", F.lit(1)), ["x"]).collect()
