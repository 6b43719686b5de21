"""Verdicts from collected metrics: bounds as data, one evaluator, and the rules built on it.

Metrics are flat dicts, as a one-row frame's ``asDict()`` gives them.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}
Bounds = dict[str, tuple[str, float]]

#: The bounds of each rule.
ADOPT_GAIN, INCONCLUSIVE_GAIN, DEGENERATE_WEIGHT = 0.01, 0.005, 0.9
CONFORMAL: dict[str, Bounds] = {
    "D1": {"pos_coverage": (">=", 0.85), "pos_wilson_low": (">=", 0.75)}, "D2": {"neg_coverage": (">=", 0.90)}, "D4": {"window_pos_coverage_min": (">=", 0.70)}, "D5": {"inference_s": ("<=", 2.0)},
}
UNCERTAIN_ALERTS, PRECISION_GAP, MONITOR_ROWS = 5, 0.05, 10
TRANSFER: Bounds = {"brier_improvement": (">=", 0.20), "ece": ("<=", 0.05)}
OPERATING: Bounds = {"f1": (">=", 0.40), "precision": (">=", 0.70), "n_alerts": ("<=", 300), "n_detected": (">=", 8)}
FUSION_PASS: Bounds = OPERATING | {"delta_pr": (">=", 0.02), "delta_pr_low": (">", 0.0), "delta_roc": (">=", 0.0), "delta_roc_low": (">=", -0.005), "mcc": (">=", 0.40), "brier": ("<=", 0.102734), "ece": ("<=", 0.10)}
FUSION_KEEP: Bounds = {"delta_roc": (">=", -0.01), "delta_pr": (">=", -0.02), "n_alerts": ("<=", 2 * 1026), "f1": (">=", 0.2256)}
AUX_MASS, WEIGHT_WIDTH, COLLAPSE = 0.05, 0.20, 0.95
FAMILY_KEEP: Bounds = {"delta_roc": (">=", -0.01), "delta_pr": (">=", -0.01), "n_alerts": ("<=", 2000)}
FAMILY_PASS: Bounds = {"delta_pr": (">", 0.0), "delta_roc": (">", -0.005), "f1": (">=", 0.30), "n_alerts": ("<=", 1500)}


def missed(metrics: Mapping[str, float], bounds: Bounds) -> list[str]:
    """The names whose bound does not hold; a missing value holds nothing."""
    return [n for n, (op, b) in bounds.items() if metrics.get(n) is None or not _OPS[op](metrics[n], b)]


def reproduces(measured: Mapping[str, float], recorded: Mapping[str, float], tolerance: float) -> list[str]:
    """Names that differ from the record by more than the tolerance."""
    return [n for n, v in recorded.items() if measured.get(n) is None or abs(measured[n] - v) > tolerance]


def at_path(record: Any, path: str) -> Any:
    """A nested value by its dotted path; None where it is missing."""
    return reduce(lambda r, k: r.get(k) if isinstance(r, Mapping) else None, path.split("."), record)


def reconcile(record: Any, measured: Mapping[str, float], tolerance: float) -> list[dict[str, Any]]:
    """For each dotted path: what a report records, what was measured, their difference and whether it is within the tolerance; a missing record is not."""
    rows = []
    for path, value in measured.items():
        old = at_path(record, path)
        gap = None if old is None else abs(value - old)
        rows.append({"path": path, "recorded": old, "measured": value, "difference": gap, "ok": gap is not None and gap <= tolerance})
    return rows


def adaptive(base: Mapping[str, float], arms: Mapping[str, Mapping[str, float]], ml_weight: float) -> str:
    """ADOPT, INCONCLUSIVE or NO: the arm with the best average precision against the base; each has pr_auc, roc_auc, precision_at_10."""
    best = max(arms.values(), key=lambda m: m["pr_auc"])
    gain = best["pr_auc"] - base["pr_auc"]
    if ml_weight >= DEGENERATE_WEIGHT or gain < INCONCLUSIVE_GAIN:
        return "NO"
    if gain < ADOPT_GAIN:
        return "INCONCLUSIVE"
    return "ADOPT" if best["roc_auc"] >= base["roc_auc"] and best["precision_at_10"] >= base["precision_at_10"] else "NO"


def feature_kept(zero_gain: bool, alone_pr: float, drop_roc: float, drop_pr: float, nonzero: float) -> str:
    """REJECT, RETAIN or INCONCLUSIVE for a feature without gain: by its value alone, what its removal changes and how often it is set."""
    if not zero_gain:
        return "INCONCLUSIVE"
    if alone_pr < 0.01 and abs(drop_roc) < 0.001 and abs(drop_pr) < 0.001 and nonzero < 0.10:
        return "REJECT"
    return "RETAIN" if alone_pr >= 0.05 or drop_pr < -0.001 else "INCONCLUSIVE"


def conformal(metrics: Mapping[str, float]) -> tuple[str, dict[str, bool]]:
    """ACCEPT, CONDITIONAL (only usefulness fails) or REJECT, and which of D1 to D5 hold."""
    held = {d: not missed(metrics, b) for d, b in CONFORMAL.items()}
    useful = (metrics["n_uncertain_alerts"] >= UNCERTAIN_ALERTS and metrics["precision_gap"] >= PRECISION_GAP) or metrics["n_monitor"] >= MONITOR_ROWS
    return ("REJECT" if not all(held.values()) else "ACCEPT" if useful else "CONDITIONAL"), held | {"D3": useful}


def calibration(arms: Mapping[str, Mapping[str, float]], gates: bool, ranking_kept: bool, tie_effect: float, tie_caution: float = 0.01) -> str:
    """PASS, CAUTION or FAIL of calibrated arms: one arm must both transfer and operate, and all must cover enough users."""
    if not gates or not ranking_kept:
        return "FAIL"
    if tie_effect > tie_caution:
        return "CAUTION"
    moves = {n for n, m in arms.items() if not missed(m, TRANSFER)}
    works = {n for n, m in arms.items() if not missed(m, OPERATING)}
    covered = all(m["n_detected"] >= OPERATING["n_detected"][1] for m in arms.values())
    return "PASS" if covered and moves & works else "CAUTION" if moves or works else "FAIL"


def fusion(arms: Mapping[str, Mapping[str, float]], gates: bool, learned: tuple[str, ...] = ()) -> str:
    """PASS, CAUTION or FAIL of fused arms, each with metrics, deltas, ml_weight, aux_low, weight_width and tied (a flag)."""
    if not gates or any(missed(m, FUSION_KEEP) for m in arms.values()):
        return "FAIL"
    better = [m for m in arms.values() if not missed(m, FUSION_PASS) and not m.get("tied")]
    if not better and any(arms[a]["ml_weight"] >= COLLAPSE for a in learned):
        return "FAIL"
    owed = [m for m in better if 1 - m["ml_weight"] >= AUX_MASS and m["aux_low"] > 0 and m["weight_width"] <= WEIGHT_WIDTH]
    return "PASS" if owed else "CAUTION"


def family(selected: Mapping[str, float] | None, base: Mapping[str, float]) -> str:
    """PASS, CAUTION or FAIL of a selected fusion family against the model alone."""
    if selected is None:
        return "CAUTION"
    m = dict(selected) | {"delta_pr": selected["pr_auc"] - base["pr_auc"], "delta_roc": selected["roc_auc"] - base["roc_auc"]}
    return "FAIL" if missed(m, FAMILY_KEEP) else "CAUTION" if missed(m, FAMILY_PASS) else "PASS"


def holdout_bands(roc_auc: float, pr_auc: float, n_detected: int, record: Mapping[str, float]) -> dict[str, str]:
    """How a holdout compares with a record: comparable, inconclusive or materially worse; high, moderate or low coverage."""
    roc, pr = roc_auc - record["roc_auc"], (pr_auc - record["pr_auc"]) / record["pr_auc"]
    band = lambda d, near, worse: "comparable" if abs(d) <= near else "materially worse" if d < -worse else "inconclusive"
    return {"roc_auc": band(roc, 0.02, 0.05), "pr_auc": band(pr, 0.20, 0.40), "coverage": "high" if n_detected >= 12 else "moderate" if n_detected >= 8 else "low"}


def only_days(df: DataFrame, first: str, last: str) -> DataFrame:
    """``df``; a row outside the days fails when it is read."""
    inside = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return df.withColumn("day", F.when(inside, F.col("day")).otherwise(F.raise_error(F.lit("a day outside the allowed range")).cast("date")))


def day_gate(df: DataFrame, expected: int) -> DataFrame:
    """One row: distinct days and whether they are as many as expected."""
    return df.agg(F.countDistinct("day").alias("n_days")).withColumn("ok", F.col("n_days") == expected)


def bound_counts(checks: DataFrame) -> DataFrame:
    """(bound, n_pass, n_caution, n_fail) of :func:`vigilake.operators.policies.bounds`."""
    return checks.groupBy("bound").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "caution", "fail")])


def window_consistency(checks: DataFrame) -> DataFrame:
    """(window, ok): whether a window breaks no bound."""
    return checks.groupBy("window").agg(F.bool_and(F.col("status") == "pass").alias("ok"))


def weighted_windows(rows: DataFrame) -> DataFrame:
    """One row over windows with n_positives, n_alerts, recall, f1: recall by positives and F1 by alerts."""
    at_least = lambda c: F.greatest(F.coalesce(F.sum(c), F.lit(0)), F.lit(1))
    return rows.agg(F.count(F.lit(1)).alias("n_windows"), (F.sum(F.col("recall") * F.col("n_positives")) / at_least("n_positives")).alias("recall"), (F.sum(F.col("f1") * F.col("n_alerts")) / at_least("n_alerts")).alias("f1"))


def gain_ranking(gain: Mapping[str, float], importance: DataFrame) -> DataFrame:
    """(feature, gain_rank, shown_rank, delta) of a fixed list of features."""
    from pyspark.sql import Window

    ranks = importance.sparkSession.createDataFrame([(f, i + 1) for i, (f, _) in enumerate(sorted(gain.items(), key=lambda x: (-x[1], x[0])))], "feature string, gain_rank int")
    shown = importance.withColumn("shown_rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")))
    return ranks.join(shown, "feature").select("feature", "gain_rank", "shown_rank", (F.col("shown_rank") - F.col("gain_rank")).alias("delta"))
