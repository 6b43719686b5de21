import pytest
from pyspark.sql import functions as F

from vigilake.operators import rules


def test_adaptive():
    base = {"pr_auc": 0.2, "roc_auc": 0.9, "precision_at_10": 0.5}
    arm = lambda gain, **x: {"b": base | {"pr_auc": 0.2 + gain} | x}
    assert rules.adaptive(base, arm(0.02), 0.5) == "ADOPT"
    assert rules.adaptive(base, arm(0.02), 0.95) == "NO"
    assert rules.adaptive(base, arm(0.02, roc_auc=0.8), 0.5) == "NO"
    assert rules.adaptive(base, arm(0.007), 0.5) == "INCONCLUSIVE"


@pytest.mark.parametrize("args, want", [((False, 0, 0, 0, 0), "INCONCLUSIVE"), ((True, 0.001, 0, 0, 0.01), "REJECT"), ((True, 0.06, 0, 0, 0.01), "RETAIN"), ((True, 0.02, 0, 0, 0.5), "INCONCLUSIVE")])
def test_feature_kept(args, want):
    assert rules.feature_kept(*args) == want


def test_conformal():
    good = {"pos_coverage": 0.9, "pos_wilson_low": 0.8, "neg_coverage": 0.95, "window_pos_coverage_min": 0.75, "inference_s": 0.1, "n_uncertain_alerts": 6, "precision_gap": 0.1, "n_monitor": 0}
    assert rules.conformal(good)[0] == "ACCEPT"
    assert rules.conformal(good | {"n_uncertain_alerts": 0})[0] == "CONDITIONAL"
    assert rules.conformal(good | {"pos_coverage": 0.5})[0] == "REJECT"


def test_calibration_and_fusion():
    arm = {"brier_improvement": 0.3, "ece": 0.01, "f1": 0.5, "precision": 0.8, "n_alerts": 100, "n_detected": 9}
    assert rules.calibration({"B": arm}, True, True, 0.0) == "PASS"
    assert rules.calibration({"B": arm | {"ece": 0.2}}, True, True, 0.0) == "CAUTION"
    assert rules.calibration({"B": arm}, False, True, 0.0) == "FAIL"
    full = arm | {"delta_pr": 0.03, "delta_pr_low": 0.01, "delta_roc": 0.01, "delta_roc_low": 0.0, "mcc": 0.5, "brier": 0.05, "ml_weight": 0.6, "aux_low": 0.1, "weight_width": 0.1}
    assert rules.fusion({"C": full}, True) == "PASS"
    assert rules.fusion({"C": full | {"weight_width": 0.5}}, True) == "CAUTION"
    assert rules.fusion({"C": full | {"delta_roc": -0.5}}, True) == "FAIL"
    assert rules.fusion({"C": full | {"delta_pr": 0.0, "ml_weight": 0.99}}, True, ("C",)) == "FAIL"


def test_family_and_bands():
    base = {"pr_auc": 0.2, "roc_auc": 0.9}
    new = {"pr_auc": 0.25, "roc_auc": 0.9, "f1": 0.4, "n_alerts": 100}
    assert rules.family(None, base) == "CAUTION" and rules.family(new, base) == "PASS" and rules.family(new | {"n_alerts": 3000}, base) == "FAIL"
    assert rules.holdout_bands(0.9, 0.1, 13, base) == {"roc_auc": "comparable", "pr_auc": "materially worse", "coverage": "high"}
    assert rules.at_path({"a": {"b": 1}}, "a.b") == 1 and rules.at_path({"a": 1}, "a.b") is None
    assert rules.reproduces({"x": 1.0}, {"x": 1.1, "y": 0}, 0.05) == ["x", "y"]


def test_day_guards(spark):
    df = spark.createDataFrame([("2010-01-01",), ("2010-01-09",)], "day string").select(F.to_date("day").alias("day"))
    assert rules.day_gate(df, 2).first()["ok"]
    assert rules.only_days(df, "2010-01-01", "2010-01-09").count() == 2
    with pytest.raises(Exception):
        rules.only_days(df, "2010-01-01", "2010-01-05").collect()


def test_bound_tables(spark):
    checks = spark.createDataFrame([(0, "B1", "pass"), (0, "B2", "caution"), (1, "B1", "pass")], "window int, bound string, status string")
    assert sorted(map(tuple, rules.bound_counts(checks).collect())) == [("B1", 2, 0, 0), ("B2", 0, 1, 0)]
    assert sorted(map(tuple, rules.window_consistency(checks).collect())) == [(0, False), (1, True)]
    rows = spark.createDataFrame([(2, 4, 0.5, 0.25), (6, 0, 1.0, 0.0)], "n_positives int, n_alerts int, recall double, f1 double")
    assert tuple(rules.weighted_windows(rows).first()) == (2, 0.875, 0.25)
    ranks = rules.gain_ranking({"a": 2.0, "b": 1.0}, spark.createDataFrame([("a", 0.1), ("b", 0.5)], "feature string, mean_abs double"))
    assert sorted(map(tuple, ranks.collect())) == [("a", 1, 2, 1), ("b", 2, 1, -1)]
