import hashlib
from datetime import date

import pytest

from vigilake.operators import features, graph
from vigilake.sources import readers


def test_log_reader(spark, tmp_path):
    (tmp_path / "logon.csv").write_text("id,date,user,pc,activity\n{A-1},01/02/2010 07:00:00,AAA0001,PC-0001,Logon\n{A-2},bad,AAA0001,,Logoff\n")
    rows = readers.read_log(spark, "logon", str(tmp_path / "logon.csv")).orderBy("id").collect()
    assert str(rows[0]["day"]) == "2010-01-02" and rows[1]["ts"] is None and rows[1]["pc"] is None
    assert readers.read_table(spark, str(tmp_path / "logon.csv")).count() == 2


def test_insiders(spark, tmp_path):
    (tmp_path / "k.csv").write_text("dataset,scenario,details,user,start,end\n4.2,1,x,AAA0001,01/04/2010 01:00:00,2010-01-05 01:00:00\n5.1,1,x,BBB0002,01/04/2010 01:00:00,oops\n")
    assert [(r["user"], str(r["start"]), str(r["end"])) for r in readers.read_insiders(spark, str(tmp_path / "k.csv")).collect()] == [("AAA0001", "2010-01-04", "2010-01-05")]
    assert readers.read_insiders(spark, str(tmp_path / "k.csv"), None).count() == 2


def test_digest_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert readers.canonical_digest(df).first() == readers.canonical_digest(df.orderBy("y").repartition(3)).first()
    assert readers.canonical_json({"b": {2, 1}, "a": None}) == '{"a":null,"b":[1,2]}'


def test_folds(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    readers.write_fold(df, str(tmp_path), 1, 0, "h")
    readers.write_fold(df, str(tmp_path), 1, 1, "other")
    assert [tuple(r) for r in readers.read_folds(spark, str(tmp_path), 1, "h").select("x", "fold").collect()] == [(1, 0)]


def test_md5(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert readers.file_md5(spark, str(tmp_path / "f")).first()["md5"] == "900150983cd24fb0d6963f7d28e17f72"


def test_resume_fails_on_another_allocation(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    assert readers.done_folds(spark, str(tmp_path), 1, "h", "a") == []
    readers.write_fold(df, str(tmp_path), 1, 0, "h", "a")
    readers.write_fold(df, str(tmp_path), 1, 2, "h", "a")
    assert readers.done_folds(spark, str(tmp_path), 1, "h", "a") == [0, 2]
    with pytest.raises(ValueError, match="another table or allocation"):
        readers.done_folds(spark, str(tmp_path), 1, "h", "b")


def test_digest_counts_repeated_rows(spark):
    twice = lambda v: readers.canonical_digest(spark.createDataFrame([(v,), (v,)], "x int")).first()
    assert twice(1) != twice(2) and twice(1) != readers.canonical_digest(spark.createDataFrame([(1,)], "x int")).first()


def test_md5_of_a_file_longer_than_a_block(spark, tmp_path):
    data = bytes(range(256)) * 40_000
    (tmp_path / "big").write_bytes(data)
    r = readers.file_md5(spark, str(tmp_path / "big")).first()
    assert r["md5"] == hashlib.md5(data).hexdigest() and r["length"] == len(data)


def test_report_is_one_canonical_file(spark, tmp_path):
    text = readers.save_report(spark, {"b": [1, None], "a": date(2010, 1, 4)}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text() == text == '{"a":"2010-01-04","b":[1,null]}'


RAW = {
    "logon": "id,date,user,pc,activity\n{L1},01/04/2010 06:00:00,AAA0001,PC-0001,Logon\n{L2},01/04/2010 09:00:00,AAA0001,PC-0001,Logon\n{L3},01/04/2010 17:00:00,AAA0001,PC-0001,Logoff\n"
    "{L4},01/05/2010 10:00:00,AAA0001,PC-0002,Logon\n{L5},01/04/2010 22:00:00,BBB0002,PC-0100,Logon\n{L6},01/04/2010 23:00:00,BBB0002,PC-0100,Logoff\n{L7},null,null,null,Logon\n",
    "device": "id,date,user,pc,activity\n{D1},01/04/2010 08:00:00,AAA0001,PC-0001,Connect\n{D2},01/04/2010 08:05:00,AAA0001,PC-0001,Disconnect\n{D3},01/05/2010 11:00:00,AAA0001,PC-0002,Connect\n{D4},01/04/2010 22:05:00,BBB0002,PC-0100,Connect\n",
    "file": "id,date,user,pc,filename,content\n{F1},01/04/2010 08:10:00,AAA0001,PC-0001,a.doc,D0-CF-11-E0-A1-B1-1A-E1 xx\n{F2},01/04/2010 08:11:00,AAA0001,PC-0001,b.pdf,25-50-44-46-2D xx\n{F3},01/05/2010 11:05:00,AAA0001,PC-0002,c.jpg,FF-D8 xx\n",
    "http": "id,date,user,pc,url,content\n{H1},01/04/2010 06:05:00,AAA0001,PC-0001,http://a.com,kw\n{H2},01/04/2010 06:10:00,AAA0001,PC-0001,http://b.com,kw\n{H3},01/04/2010 09:30:00,BBB0002,PC-0100,http://c.com,kw\n",
}


def test_raw_files_to_table(spark, tmp_path):
    paths = {}
    for name, text in RAW.items():
        paths[name] = str(tmp_path / f"{name}.csv")
        (tmp_path / f"{name}.csv").write_text(text)
    got = {(r["user_id"], r["day"].day): tuple(r[c] for c in features.COUNTS) for r in readers.read_features(spark, paths, date(2010, 1, 4), date(2010, 1, 5)).collect()}
    assert got == {("AAA0001", 4): (2, 1, 1, 2, 2, 2, 1, 2), ("AAA0001", 5): (1, 0, 1, 1, 0, 0, 1, 1), ("BBB0002", 4): (1, 1, 1, 0, 0, 1, 1, 1), ("BBB0002", 5): (0,) * 8}


def test_directory_snapshots(spark, tmp_path):
    head = "employee_name,user_id,email,role,business_unit,functional_unit,department,team,supervisor\n"
    for month, role, dept in (("2009-12", "Clerk", "Sales"), ("2010-01", "Manager", "null")):
        (tmp_path / f"{month}.csv").write_text(head + f"A,AAA0001,a@x,{role},1,2,{dept},t,s\n")
    snapshots = readers.read_ldap(spark, {m: str(tmp_path / f"{m}.csv") for m in ("2009-12", "2010-01")})
    days = spark.createDataFrame([("AAA0001", date(2010, 1, 4)), ("AAA0001", date(2010, 2, 4))], "user_id string, day date")
    assert [r["department"] for r in graph.department_of_day(days, snapshots).orderBy("day").collect()] == ["Sales", None]
    assert tuple(readers.latest_roles(snapshots).first()) == ("AAA0001", "Manager", None)
