"""Contributions of trees, cohort shift, weight search, families and folds, on small tables."""

import random
from datetime import date, timedelta
from itertools import combinations
from math import factorial
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.operators import components, drift, features, fusion, learned, metrics, ordered, policies, resampling, shift, treeshap

NAMES = ["p", "q", "s"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for u in range(24):
        for d in range(20):
            p, q, s = rng.randint(0, 6), rng.random(), rng.randint(0, 3)
            y = int(p + 3 * q > 6 and u % 3 == 0)
            rows.append((f"USR{u:04}", date(2010, 1, 4) + timedelta(d), float(p), q, float(s), y, "train" if d < 10 else "calibration" if d < 15 else "test"))
    return spark.createDataFrame(rows, "user_id string, day date, p double, q double, s double, is_malicious int, split string").cache()


def conditional(node, x, known):
    """Mean of a tree where only the features in ``known`` have values."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    f, cut = node.split().featureIndex(), node.split().threshold()
    if f in known:
        return conditional(node.leftChild() if x[f] <= cut else node.rightChild(), x, known)
    sides = [node.leftChild(), node.rightChild()]
    return sum(c.impurityStats().count() / node.impurityStats().count() * conditional(c, x, known) for c in sides)


def test_contributions_are_shapley_values(spark, table):
    model = learned.fit_trees(table, NAMES, rounds=4, depth=3)
    got = treeshap.tree_contributions(model, table, NAMES, ["user_id", "day"]).orderBy("user_id", "day").limit(6).collect()
    trees = [(t._call_java("rootNode"), w) for t, w in zip(model[1].trees, model[1].treeWeights, strict=True)]
    for r in got:
        x = [r[n] for n in NAMES]
        value = lambda known: sum(w * conditional(t, x, known) for t, w in trees)  # noqa: B023, E731
        for j, n in enumerate(NAMES):
            rest = [i for i in range(3) if i != j]
            want = sum(factorial(k) * factorial(2 - k) / 6 * (value({*c, j}) - value(set(c))) for k in range(3) for c in combinations(rest, k))
            assert r[f"contribution_{n}"] == pytest.approx(want, abs=1e-9)
        assert r["bias"] == pytest.approx(value(set())) and r["bias"] + sum(r[f"contribution_{n}"] for n in NAMES) == pytest.approx(r["margin"])
    own = {(r["user_id"], r["day"]): r["margin"] for r in learned.margin(model, table).collect()}
    assert all(own[r["user_id"], r["day"]] == pytest.approx(r["margin"]) for r in got)


def test_alert_patterns(spark):
    df = spark.createDataFrame([(0.5, -0.2, 0.0), (-0.1, -0.4, 0.3)], ", ".join(f"contribution_{n} double" for n in NAMES))
    got = {r["feature"]: r for r in treeshap.alert_patterns(df, NAMES).collect()}
    assert (got["p"]["top_up"], got["s"]["top_up"], got["q"]["top_down"], got["s"]["zero"]) == (0.5, 0.5, 1.0, 0.5)
    assert (got["p"]["mean_rank"], got["q"]["mean_rank"], got["s"]["top3"], got["q"]["top1"]) == (2.0, 1.5, 0.5, 0.5)


def test_quantiles_and_ranking_by_group(spark, table):
    counts = table.groupBy("split", F.col("q").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    got = {r["split"]: r["quantiles"] for r in shift.quantiles_by(counts, ["split"], "v", "n", (0.0, 0.1, 0.5, 0.9, 1.0)).collect()}
    auc = {r["split"]: r for r in metrics.ranking_by(table, ["split"], "p", "is_malicious").collect()}
    for split in ("train", "calibration", "test"):
        own = [r for r in table.filter(F.col("split") == split).collect()]
        assert np.allclose(got[split], np.quantile([r["q"] for r in own], [0.0, 0.1, 0.5, 0.9, 1.0]))
        one = metrics.ranking_metrics(table.filter(F.col("split") == split), "p", "is_malicious").first()
        assert auc[split]["roc_auc"] == pytest.approx(one["roc_auc"]) and auc[split]["pr_auc"] == pytest.approx(one["pr_auc"]) and auc[split]["n"] == len(own)


def test_feature_shift(spark, table):
    got = {r["feature"]: r for r in shift.feature_shift(table, NAMES, ["p", "s"]).collect()}
    rows = table.collect()
    for n in NAMES:
        by = {s: [float(np.median([r[n] for r in rows if r["user_id"] == u and r["split"] == s])) for u in sorted({r["user_id"] for r in rows})] for s in ("train", "calibration", "test")}
        by = {s: np.log1p(v) if n != "q" else np.array(v) for s, v in by.items()}
        a, c = by["train"], by["test"]
        pooled = np.sqrt((a.var(ddof=1) + c.var(ddof=1)) / 2)
        assert got[n]["d_train_test"] == pytest.approx((a.mean() - c.mean()) / pooled, abs=1e-9)
        every = np.concatenate([a, c])
        assert got[n]["ks_train_test"] == pytest.approx(max(abs((a <= v).mean() - (c <= v).mean()) for v in every))
        one = drift.psi(table, n, "split", "train", "test").first()[0]
        assert got[n]["psi_test"] == pytest.approx(one)
    assert sorted(r["drift_rank"] for r in got.values()) == [1, 2, 3]


def test_text_ids(spark, table):
    folds = {r["user_id"]: r["fold"] for r in resampling.round_robin(table, 5).collect()}
    assert folds == {f"USR{u:04}": u % 5 for u in range(24)}
    blocks = resampling.allocate(table)
    assert blocks.count() == 24 and {r["block"] for r in blocks.collect()} <= {"train", "calibration", "test"}
    words = spark.createDataFrame([(w,) for w in ("b", "a", "ab", "é", "aa")], "w string")
    assert {r["w"]: r["n"] for r in ordered.running(words, "w", {"n": F.lit(1)}, parts=2).collect()} == {"a": 1, "aa": 2, "ab": 3, "b": 4, "é": 5}


def test_learned_weights_find_the_component_that_ranks(spark, table):
    df = table.withColumns({"good": (F.col("is_malicious") * 0.5 + F.col("q") * 0.5), "noise": F.col("s") / 3, "more": F.lit(0.5)})
    got = fusion.learn_weights(df.filter("split = 'train'"), df.filter("split = 'calibration'"), ["good", "noise", "more"], top=5).collect()
    best = [r for r in got if r["chosen"]]
    assert len(got) == 5 and len(best) == 1 and best[0]["weights"][0] > best[0]["weights"][1]
    assert best[0]["calibration_pr_auc"] == max(r["calibration_pr_auc"] for r in got)


def test_families(spark, table):
    df = table.withColumns({"r_ml": F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("p") / 6)), "r_trust": F.col("q"), "r_context": F.col("s") / 3, "r_behavior": F.lit(0.5)})
    train, new = df.filter("split = 'train'"), df.filter("split = 'test'")
    base = {(r["user_id"], r["day"]): r["r_ml"] for r in new.collect()}
    for family, setting in (("A0", None), ("B", None), ("C", 1.0), ("D", 0.1), ("E", 0.1), ("F1", 0.5), ("F2", 0.0), ("G", None), ("H1", None)):
        got = fusion.apply_family(train, new, family, setting).collect()
        assert len(got) == len(base) and all(0 <= r["fused"] <= 1 for r in got)
        if family == "A0":
            assert all(r["fused"] == base[r["user_id"], r["day"]] for r in got)
        if family in ("C", "D"):
            assert metrics.ranking_metrics(fusion.apply_family(train, new, family, setting), "fused", "is_malicious").first()["roc_auc"] > 0.8
    with pytest.raises(ValueError, match="unknown family"):
        fusion.apply_family(train, new, "Z")


def test_arms_and_holdout(spark, table):
    part = lambda s: table.filter(F.col("split") == s)
    r = fusion.run_arm(part("train"), part("calibration"), part("test"), NAMES, rounds=3, depth=3).first()
    assert r["n"] == 24 * 5 and r["roc_auc"] > 0.8 and r["n_alerts"] == r["tp"] + r["fp"] and r["n_days"] == 5
    held = fusion.user_holdout(table.drop("split"), NAMES, rounds=3, depth=3).first()
    assert held["n"] % 20 == 0 and 0 < held["n"] < 24 * 20


def test_nested_folds_and_resume(spark, table):
    roles = table.select("user_id").distinct().select("user_id", F.lit("r").alias("role"), F.lit("d").alias("department"))
    got = fusion.nested_cv(table.drop("split"), NAMES, roles, [("A0", None), ("B", None)], ["p"], ["q"], ["s"], folds=2, done=lambda k: k == 1, rounds=2, depth=2).collect()
    assert [(r["fold"], r["family"]) for r in got] == [(0, "A0"), (0, "B")] and all(0 <= r["f1"] <= 1 for r in got)
    with pytest.raises(ValueError, match="all folds"):
        fusion.nested_cv(table.drop("split"), NAMES, roles, [("A0", None)], ["p"], ["q"], ["s"], folds=2, done=lambda k: True)


def test_nested_folds_share_their_work_and_equal_each_fold_alone(spark, table, monkeypatch, families=(("D", 0.1), ("G", None)), folds=2):
    calls, one = [], components.behaviour_risk
    monkeypatch.setattr(components, "behaviour_risk", lambda *a, **k: calls.append(1) or one(*a, **k))
    monkeypatch.setattr(learned, "fit_trees", lambda *a, **k: None)
    monkeypatch.setattr(learned, "predict", lambda model, df, out="score": df.withColumn(out, F.round(0.05 + F.col("p") / 12, 6)))
    table = table.drop("split")
    roles = table.select("user_id").distinct().select("user_id", F.substring("user_id", 7, 1).alias("role"), F.lit("d").alias("department"))
    got = {(r["fold"], r["family"]): r for r in fusion.nested_cv(table, NAMES, roles, list(families), ["p"], ["q"], ["s"], folds=folds).collect()}
    assert len(calls) == 1 and len(got) == folds * len(families)
    dealt = table.join(resampling.round_robin(table, folds), "user_id").localCheckpoint()
    for k in range(folds):
        train, val = (dealt.filter(c).drop("fold") for c in (F.col("fold") != k, F.col("fold") == k))
        block = [learned.predict(None, p, "r_ml").select("user_id", "day", "is_malicious", "r_ml").join(fusion.component_block(p, train, roles, ["p"], ["q"], ["s"]), ["user_id", "day"]).localCheckpoint() for p in (train, val)]
        for family, setting in families:
            fused = fusion.apply_family(*block, family, setting).localCheckpoint()
            t, r = metrics.best_f1_threshold(fused, "fused", "is_malicious").first(), got[k, family]
            own = metrics.binary_metrics(fused, F.col("fused") >= t["threshold"], F.col("is_malicious")).first()
            rank = metrics.ranking_metrics(fused, "fused", "is_malicious").first()
            want = [t["threshold"], t["f1"], *[own[c] for c in ("n_alerts", "precision", "recall", "mcc")], rank["roc_auc"], rank["pr_auc"]]
            assert [r[c] for c in ("threshold", "f1", "n_alerts", "precision", "recall", "mcc", "roc_auc", "pr_auc")] == pytest.approx(want, rel=1e-9)


def test_combined_policies(spark, table):
    df = table.withColumn("score", F.col("p") / 10 + F.col("q") / 4)
    got = {r["policy"]: r for r in fusion.combined_policies(df, 0.5, days=(5,), windows=(1, 3, 7)).collect()}
    assert set(got) == {"P0", "P1", "P2", "P3", "P4"} and got["P1"]["n_alerts"] == got["P0"]["n_alerts"] >= got["P2"]["n_alerts"] >= got["P3"]["n_alerts"]


def test_masks_agree_with_each_policy(spark, table):
    df = table.withColumn("score", F.round(F.col("p") / 10, 1))
    kinds = {"T": ("threshold", 0.4), "C2": ("capacity", 2), "C5": ("capacity", 5), "P1": ("percentile", 0.1), "P2": ("percentile", 0.33)}
    got = {(r["user_id"], r["day"], c["candidate"]): c["alert"] for r in policies.masks(df, kinds).collect() for c in r["candidates"]}
    for name, (kind, param) in kinds.items():
        for r in policies.policy(df, kind, param).collect():
            assert got[r["user_id"], r["day"], name] == r["alert"]


def test_context_risk_by_definition(spark, table):
    pools = table.select("user_id").distinct().select("user_id", (F.substring("user_id", 7, 1)).alias("pool"))
    got = {(r["user_id"], r["day"]): r["r_context"] for r in components.context_risk(table.select("user_id", "day", "p", "q"), pools, ["p", "q"]).collect()}
    rows = table.collect()
    for r in random.Random(1).sample(rows, 25):
        peers = [x for x in rows if x["user_id"][6:7] == r["user_id"][6:7] and x["user_id"] != r["user_id"] and x["day"] < r["day"]]
        same = [x for x in peers if (x["day"].weekday() < 5) == (r["day"].weekday() < 5)]
        use = same if len(same) >= 20 else peers
        want = 0.5
        if len(use) >= 20:
            from statistics import NormalDist, median

            z = []
            for n in ("p", "q"):
                m = median(x[n] for x in use)
                mad = median(abs(x[n] - m) for x in use)
                z.append(0.0 if mad < 1e-9 else min(abs(r[n] - m) / (mad + 1e-6), 3.0))
            want = sum(NormalDist().cdf(v) for v in z) / 2
        assert got[r["user_id"], r["day"]] == pytest.approx(want, abs=1e-9)


def test_splits_and_order_are_checked(spark, table):
    features.check_splits(table, "2010-01-13", "2010-01-18")
    with pytest.raises(ValueError, match="empty splits"):
        features.check_splits(table, "2010-01-13", "2010-03-18")
    assert learned.check_order(table.select("user_id", "day", *NAMES), NAMES) == NAMES
    with pytest.raises(ValueError, match="extra"):
        learned.check_order(table.select("user_id", "day", "q", *NAMES[:1]), NAMES)


def test_refitted_maps():
    s, n, k = np.array([0.9, 0.1, 0.5, 0.3]), np.array([2.0, 4.0, 2.0, 2.0]), np.array([2.0, 0.0, 0.0, 1.0])
    p = resampling._bin_rates(s, n, k, np.array([0.05, 0.3, 0.5, 0.95]), 4)
    assert list(p) == [0.0, 0.25, 0.25, 1.0] and (np.diff(p) >= 0).all()
    assert list(resampling._mid_ranks(s, n, k, np.array([0.0, 0.1, 0.4, 1.0]))) == [0.0, 0.15, 0.55, 0.95]


def test_map_refit_intervals(spark, table):
    df = table.withColumn("score", F.round(F.col("p") / 6, 2))
    got = {r["metric"]: r for r in resampling.map_refit(df.filter("split = 'train'"), df.filter("split = 'test'"), "bins", 40).collect()}
    assert set(got) == {"brier", "mean_p"} and all(r["n_valid"] == 40 and 0 <= r["ci_low"] <= r["ci_high"] <= 1 for r in got.values())


def _plain_context(rows, features, least=20):
    """The risk of each row by its definition."""
    from statistics import NormalDist, median

    out = []
    for r in rows:
        peers = [x for x in rows if x["pool"] == r["pool"] and x["user_id"] != r["user_id"] and x["day"] < r["day"]]
        same = [x for x in peers if (x["day"].weekday() < 5) == (r["day"].weekday() < 5)]
        use = same if len(same) >= least else peers
        z = []
        for f in features if r["pool"] and len(use) >= least else []:
            m = median(x[f] for x in use)
            mad = median(abs(x[f] - m) for x in use)
            z.append(0.0 if mad < 1e-9 else min(abs((r[f] - m) / (mad + 1e-6)), 3.0))
        out.append((r["user_id"], r["day"], r["a"], sum(NormalDist().cdf(v) for v in z) / len(z) if z else 0.5))
    return sorted(out)


def test_context_risk_of_dealt_pools(spark, monkeypatch):
    rng = random.Random(5)
    rows = [{"user_id": u, "day": date(2024, 1, 1) + timedelta(d), "a": rng.randrange(4), "b": round(rng.random(), 3), "c": rng.choice([0, 0, 0, 1]), "pool": ("x", "x", "y", None)[u % 4]} for u in range(16) for d in range(18) if rng.random() < 0.9]
    rows += [dict(rows[7], a=9, b=0.5)]  # a day of a user with two rows
    df = spark.createDataFrame([(r["user_id"], r["day"], r["a"], r["b"], r["c"]) for r in rows], "user_id long, day date, a int, b double, c int")
    pools = spark.createDataFrame([(u, ("x", "x", "y", None)[u % 4]) for u in range(16)], "user_id long, pool string")
    monkeypatch.setattr(components, "POOL_ROWS", 25)
    got = sorted((r["user_id"], r["day"], r["a"], r["r_context"]) for r in components.context_risk(df, pools, ["a", "b", "c"]).collect())
    want = _plain_context(rows, ["a", "b", "c"])
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)


def test_behaviour_risk_takes_many_users_a_task(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(u, date(2024, 1, 1) + timedelta(d), rng.randrange(5), rng.random()) for u in range(20) for d in range(25) if rng.random() < 0.5 + u / 40]
    monkeypatch.setattr(components, "USER_ROWS", 60)
    found = components.behaviour_risk(spark.createDataFrame(rows, "user_id long, day date, a int, b double"), ["a", "b"], min_history=5)
    got = {(r["user_id"], r["day"]): r["r_behavior"] for r in found.collect()}
    assert "__part" in found._jdf.queryExecution().analyzed().toString() and len(got) == len(rows)
    for u in range(20):
        own = sorted(r for r in rows if r[0] == u)
        for d, r in enumerate(own):
            z = []
            for i in (2, 3):
                m = float(np.median([x[i] for x in own[:d]])) if d else 0.0
                mad = float(np.median([abs(x[i] - m) for x in own[:d]])) if d else 0.0
                z.append(0.0 if d < 5 or mad < 1e-9 else min(abs((r[i] - m) / (mad + 1e-6)), 3.0))
            assert got[u, r[1]] == pytest.approx(sum(NormalDist().cdf(v) for v in z) / 2, abs=1e-9)
