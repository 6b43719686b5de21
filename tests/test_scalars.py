"""Column functions, checks and small operators that no query names."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from vigilake.functions import scalar
from vigilake.operators import components, decision, learned, quality, rules
from vigilake.sources import readers


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column).first()[0]


def test_scalars(spark):
    a, b = F.col("a"), F.col("b")
    assert value(spark, scalar.ratio(a, b), a=3, b=0) == 3.0 and value(spark, scalar.ratio(a, b), a=3, b=4) == 0.75
    assert value(spark, scalar.close(a, b), a=1e12, b=1e12 + 1) and not value(spark, scalar.close(a, b), a=1.0, b=1.1)
    assert value(spark, scalar.drift_scale(a, True), a=2.0) == 2.0 and value(spark, scalar.drift_scale(a, False), a=0.0) == 0.0
    assert [value(spark, scalar.explained_level(a, b), a=x, b=y) for x, y in ((True, "sample"), (False, "borderline"), (False, "monitor"), (False, "sample"))] == ["ALERT", "BORDERLINE", "MONITOR", "NON-ALERT"]
    assert [value(spark, scalar.length_class(a), a=n) for n in (12, 13, 44, 45)] == ["short", "middle", "middle", "long"]
    assert value(spark, scalar.is_weekday(a), a=date(2010, 1, 8)) and not value(spark, scalar.is_weekday(a), a=date(2010, 1, 9))


def test_sentence(spark):
    row = spark.createDataFrame([("login_count", 2.5, 0.125, "increased", 1)], "feature string, value double, contribution double, direction string, rank int")
    got = row.select(decision.sentence(F.struct(*row.columns), 12)).first()[0]
    assert got == "login_count = 2.5 increased the risk (+0.1250, rank 1 of 12)"


def test_interactions_and_residual(spark):
    df = spark.createDataFrame([(0.5, 1.0, 2.0)], "m double, a double, b double")
    held, names = learned.with_interactions(df, ["a", "b"])
    assert names == ["a", "b", "a_x_b"] and held.first()["a_x_b"] == 2.0
    assert components.residual_logistic(df, "m", {"a": 0.0, "b": -3.0}).first()["fused"] == pytest.approx(0.5)


def test_binned_ratios_score(spark):
    train = spark.createDataFrame([(0.95, 1)] * 8 + [(0.05, 0)] * 8, "c double, is_malicious int")
    got = components.score_binned_ratios(spark.createDataFrame([(0.99,), (0.01,), (0.5,)], "c double"), components.fit_binned_ratios(train, ["c"]), ["c"]).collect()
    score = {r["c"]: r["fused"] for r in got}
    assert score[0.99] > 0.85 and score[0.01] < 0.15 and score[0.5] == 0.5


def test_reports_and_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert quality.schema_ok(df, ["a", "b"]) and not quality.schema_ok(df, ["b", "a"])
    readers.write_report(df, str(tmp_path / "r"))
    assert [json.loads(x) for f in (tmp_path / "r").glob("part*") for x in f.read_text().split()] == [{"a": 1, "b": "x"}]


def test_validation_of_all_files(spark, tmp_path):
    text = {
        "logon": "id,date,user,pc,activity\n{A1B2-C3D4E5F6-0001ABCD},01/04/2010 06:00:00,AAA0001,PC-0001,Logon\n{A1B2-C3D4E5F6-0002ABCD},bad,aaa1,PC-1,Sleep\n",
        "psychometric": "employee_name,user_id,O,C,E,A,N\nA B,AAA0001,1,2,3,4,5\n",
    }
    logs = {}
    for name, body in text.items():
        (tmp_path / f"{name}.csv").write_text(body)
        logs[name] = readers.read_log(spark, name, str(tmp_path / f"{name}.csv"))
    checks, whole = quality.run_validation(logs)
    got = {(r["file"], r["check"]): r["value"] for r in checks.collect()}
    assert [got["logon", c] for c in ("bad_date", "bad_user", "bad_pc", "unknown_activity", "repeated_rows")] == [1, 1, 1, 1, 0]
    assert {r["file"]: r["ok"] for r in whole.collect()} == {"logon": False, "psychometric": True, None: False}


def test_reconciliation():
    got = rules.reconcile({"a": {"f1": 0.5}}, {"a.f1": 0.6, "a.missing": 1.0}, 0.01)
    assert [(r["path"], r["ok"]) for r in got] == [("a.f1", False), ("a.missing", False)]
    assert rules.reconcile({"x": 1.0}, {"x": 1.0000001}, 1e-6)[0]["ok"]
