import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.functions import scalar
from vigilake.operators import calibration, components, decision, drift, metrics, ordered, policies, resampling
from vigilake.streaming import incremental

D = lambda n: date(2010, 1, n)


def scores(spark, pairs):
    return spark.createDataFrame([(f"u{i:03}", D(1 + i % 28), float(s), int(y)) for i, (s, y) in enumerate(pairs)], "user_id string, day date, score double, y int")


@pytest.mark.parametrize("seed", range(3))
def test_metrics_against_definitions(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice([0.1, 0.2, 0.5, 0.7, rng.random()]), int(rng.random() < 0.3)) for _ in range(60)] + [(0.5, 1), (0.5, 0)]
    df = scores(spark, pairs)
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    ap = 0.0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        hit, at = sum(s >= t for s in pos), sum(s >= t for s, _ in pairs)
        ap += sum(s == t for s in pos) / len(pos) * hit / at
    got = metrics.ranking_metrics(df).first()
    assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)
    f1 = {t: round(2 * sum(s >= t for s in pos) / (sum(s >= t for s, _ in pairs) + len(pos)), 12) for t in {s for s, _ in pairs}}
    best = max(f1.values())
    for tie, pick in (("low", min), ("high", max)):
        r = metrics.best_f1_threshold(df, tie=tie).first()
        assert (r["threshold"], r["f1"]) == (pick(t for t in f1 if f1[t] == best), pytest.approx(best))


def test_best_f1_fixtures(spark):
    assert tuple(metrics.best_f1_threshold(scores(spark, [(0.5, 1), (0.5, 0), (0.3, 1)])).first()) == (0.3, pytest.approx(0.8))
    assert tuple(metrics.best_f1_threshold(scores(spark, [(0.9, 1), (0.3, 0)])).first()) == (0.9, 1.0)


def test_one_class_has_no_auc(spark):
    assert metrics.ranking_metrics(scores(spark, [(0.1, 0), (0.2, 0)])).first()["roc_auc"] is None


def test_running_sums(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(float(v), v) for v in values], "v double, c long").repartition(7)
    got = {r["v"]: r["s"] for r in ordered.running(df, "v", {"s": F.col("c")}, parts=9).collect()}
    total = 0
    for v in sorted(values):
        total += v
        assert got[float(v)] == total


@pytest.mark.parametrize("window, days, kept", [(3, [1, 2, 3, 4], [1, 4]), (7, list(range(1, 10)), [1, 8]), (3, [5, 2, 3, 1], [1, 5])])
def test_suppression(spark, window, days, kept):
    df = spark.createDataFrame([("A", D(d), True) for d in days], "user_id string, day date, alert boolean")
    got = policies.suppress(df, window).filter("emitted").select("day").collect()
    assert sorted(r[0].day for r in got) == kept


def test_top_share_matches_sort(spark):
    rng = random.Random(5)
    df = scores(spark, [(rng.choice([0.1, 0.4, 0.4, 0.9]), 0) for _ in range(50)])
    got = {(r["user_id"], r["day"]) for r in policies.top_share(df, 0.3).filter("alert").collect()}
    rows = sorted(((-r["score"], r["user_id"], r["day"]) for r in df.collect()))[:15]
    assert got == {(u, d) for _, u, d in rows}


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        policies.policy(scores(spark, [(0.1, 0)]), "other", 1)


def test_conformal(spark):
    cal = scores(spark, [(0.1, 0), (0.2, 0), (0.3, 0), (0.4, 0), (0.9, 1), (0.95, 1)])
    asked = scores(spark, [(0.9, 0), (0.99, 0), (0.1, 0), (0.5, 0)])
    p = {r["score"]: (r["p1"], r["p0"]) for r in calibration.conformal_p(cal, asked, label="y").collect()}
    assert p[0.9][0] == pytest.approx(2 / 3) and p[0.99][0] == 1 and p[0.1][1] == 1 and p[0.5][1] == pytest.approx(1 / 5)
    t = calibration.inclusion_thresholds(cal, 0.5, label="y").first()
    assert (t["k1"], t["k0"], t["t1"], t["t0"]) == (1, 2, 0.9, 0.3)
    many = scores(spark, [(s, 0) for s in (0.2, 0.25, 0.3, 0.5, 0.9, 0.95, 0.99)])
    sets = calibration.conformal_p(cal, many, label="y").select("score", calibration.set_category(F.col("p1"), F.col("p0"), 0.5).alias("c")).orderBy("score")
    assert [r["c"] for r in sets.collect()] == ["{0}", "{0}", "{0}", "{}", "{1}", "{1}", "{1}"]
    with pytest.raises(ValueError):
        calibration.check_alpha(1.0)


def test_robust_z(spark):
    df = spark.createDataFrame([("A", D(i + 1), float(x)) for i, x in enumerate([0, 4, 8, 100])], "user_id string, day date, x double")
    for f in (components.robust_z, components.robust_z_grouped):
        z = [r["z"] for r in f(df, "x", min_history=1).orderBy("day").collect()]
        assert z[2] == pytest.approx(6 / (2 + 1e-6)) and z[3] == pytest.approx(96 / (4 + 1e-6))


def test_ecdf(spark):
    train = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    new = spark.createDataFrame([(2.5,), (-100.0,), (100.0,), (2.0,)], "v double")
    got = {r["v"]: r["p"] for r in drift.ecdf(train, new, "v").collect()}
    assert got == {2.5: 0.375, -100.0: 0.0, 100.0: 0.875, 2.0: 0.25}


def test_normal_cdf(spark):
    xs = [-3.0, -1.0, 0.0, 0.5, 3.0, 4.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scalar.normal_cdf(F.col("x"))).collect()]
    assert got == [pytest.approx(0.5 * (1 + math.erf(x / 2**0.5)), abs=1e-14) for x in xs]


def test_ewma(spark):
    df = spark.createDataFrame([("A", D(i + 1), float(s)) for i, s in enumerate([1, 0, 1])], "user_id string, day date, score double")
    assert [r["smoothed"] for r in components.ewma(df, 0.5).orderBy("day").collect()] == [1.0, 0.5, 0.75]


def test_wilson(spark):
    lo, hi = scalar.wilson(F.col("k"), F.col("n"))
    a, b = spark.createDataFrame([(0, 0), (5, 10)], "k long, n long").select(lo, hi).collect()
    assert a[0] is None and 0 < b[0] < 0.5 < b[1] < 1


def test_levels_and_actions(spark):
    df = spark.createDataFrame([(0.99,), (0.9,), (0.5,), (0.1,)], "s double")
    level = scalar.risk_level(F.col("s"))
    got = df.select(level, scalar.recommended_action(level, F.lit(2), F.col("s"))["action"], scalar.recommended_action(level, F.lit(2), F.col("s"))["rationale"]).collect()
    assert [r[0] for r in got] == ["ALERT", "BORDERLINE", "MONITOR", "NON-ALERT"]
    assert got[0][1] == "escalate_to_incident_response" and got[0][2].endswith("; 2 trust flag(s) active")


def test_bins_are_monotone(spark):
    rng = random.Random(2)
    df = scores(spark, [(s := rng.random(), int(rng.random() < s)) for _ in range(600)])
    bins = calibration.fit_bins(df)
    assert [r for _, r in bins] == sorted(r for _, r in bins) and len(bins) >= 5
    a, b = calibration.fit_platt(df)
    assert a > 0


def test_folds_are_disjoint(spark):
    df = spark.createDataFrame([(u, D(d), int(u % 7 == 0 and d == 3)) for u in range(60) for d in (1, 3)], "user_id long, day date, is_malicious int")
    blocks = resampling.allocate(df)
    assert blocks.count() == 60 and resampling.disjoint(blocks).first()[0] == 0
    assert {r["fold"] for r in resampling.round_robin(df, 5).collect()} == set(range(5))


def test_bootstrap_repeats(spark):
    rng = random.Random(3)
    df = scores(spark, [(rng.random(), int(rng.random() < 0.4)) for _ in range(80)])
    one, two = (sorted(map(tuple, resampling.bootstrap_ci(df, 30, label="y").collect())) for _ in range(2))
    assert one == two and all(lo < hi for _, _, lo, hi in one)


def test_fusion_finds_the_signal(spark):
    rng = np.random.default_rng(0)
    y = rng.random(300) < 0.3
    rows = [(float(0.8 * a + 0.1), float(b), int(a)) for a, b in zip(y, rng.random(300), strict=True)]
    w = components.fit_fusion(spark.createDataFrame(rows, "good double, noise double, is_malicious int"), ["good", "noise"], rounds=25)
    assert w["good"] > 0.8 and sum(w.values()) == pytest.approx(1)


def test_reasons_order(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5, -0.5)], "a double, b double, contribution_a double, contribution_b double")
    r = df.select(decision.top_reasons(["a", "b"], 2).alias("r")).first()["r"]
    assert [x["feature"] for x in r] == ["a", "b"] and [x["direction"] for x in r] == ["increased", "decreased"]


def test_streams_match_batches(spark, tmp_path):
    rows = [(u, f"2010-01-0{d} {h:02}:00:00", "Logon", f"2010-01-0{d}") for u in (1, 2) for d in (1, 2, 3, 4) for h in (6, 9)]
    df = spark.createDataFrame(rows, "user_id long, ts string, activity string, day string").select("user_id", F.to_timestamp("ts").alias("ts"), "activity", F.to_date("day").alias("day"))
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = incremental.user_day_counts(live).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    counts.processAllAvailable()
    counts.stop()
    assert sorted(map(tuple, spark.table("counts").select("user_id", "login_count", "after_hours_login_count").collect())) == sorted((u, 2, 1) for u in (1, 2) for _ in range(4))
    kept = incremental.suppress_alerts(live, 3).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    kept.processAllAvailable()
    kept.stop()
    batch = policies.suppress(df.select("user_id", "day").distinct().withColumn("alert", F.lit(True)), 3).filter("emitted").select("user_id", "day")
    assert sorted(map(tuple, spark.table("kept").collect())) == sorted(map(tuple, batch.collect()))


def test_registered_bootstraps_run_the_recorded_replicates():
    import re
    from inspect import getsource

    from vigilake.plans import risk_queries

    text = getsource(risk_queries)
    for name, n in (("bootstrap_ci", 1000), ("operating_ci", 1000), ("paired_delta", 1000), ("threshold_ci", 200), ("platt_refit", 1000)):
        call = re.search(rf"resampling\.{name}\(.*", text).group()
        assert re.search(rf"\b{n}\b", call)
    assert "rounds=10" not in text
