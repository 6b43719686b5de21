"""Ranking and threshold metrics, exact under ties; each is a small DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.scalar import wilson
from vigilake.operators.ordered import by_score, running


def binary_metrics(df: DataFrame, alert: Column, label: Column, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Confusion counts and their ratios; degenerate ratios are 0. ``weight`` names a column of how many rows a row stands for."""
    y, a = label == 1, F.coalesce(alert, F.lit(False))
    count = F.count_if if weight is None else (lambda c: F.sum(F.when(c, F.col(weight)).otherwise(0)))
    c = df.groupBy(*(by or [])).agg(
        count(F.lit(True)).alias("n"), count(y).alias("n_positives"), count(a & y).alias("tp"), count(a & ~y).alias("fp"), count(~a & y).alias("fn"), count(~a & ~y).alias("tn")
    )
    d = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn", "n")}
    least = lambda x: F.greatest(x, F.lit(1.0))
    precision, recall = d["tp"] / least(d["tp"] + d["fp"]), d["tp"] / least(d["tp"] + d["fn"])
    product = (d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) * (d["tn"] + d["fp"]) * (d["tn"] + d["fn"])
    return c.select(
        "*", (F.col("tp") + F.col("fp")).alias("n_alerts"), precision.alias("precision"), recall.alias("recall"),
        (2 * d["tp"] / F.greatest(2 * d["tp"] + d["fp"] + d["fn"], F.lit(1e-9))).alias("f1"),
        F.when(product > 0, (d["tp"] * d["tn"] - d["fp"] * d["fn"]) / F.sqrt(F.when(product > 0, product))).otherwise(F.lit(0.0)).alias("mcc"),
        ((recall + d["tn"] / least(d["tn"] + d["fp"])) / 2).alias("balanced_accuracy"), (d["fp"] / least(d["fp"] + d["tn"])).alias("fpr"), (d["fn"] / least(d["fn"] + d["tp"])).alias("fnr"),
        ((d["tp"] + d["fp"]) / least(d["n"])).alias("alert_rate"),
    )


def roc_points(df: DataFrame, score: str = "score", label: str = "y", weight: Column | None = None) -> DataFrame:
    """(threshold, n, pos, tp, fp): counts at or above each distinct score."""
    points = running(by_score(df, score, label, weight), "score", {"tp": F.col("pos"), "at": F.col("n")}, descending=True)
    return points.select(F.col("score").alias("threshold"), "n", "pos", "tp", (F.col("at") - F.col("tp")).alias("fp"))


def _totals(df: DataFrame, label: str, score: str) -> DataFrame:
    rows = df.filter(F.col(score).isNotNull())
    return rows.agg(F.sum(label).alias("p_all"), (F.count(F.lit(1)) - F.sum(label)).alias("n_all"))


def curves(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """ROC and precision-recall points of each distinct score."""
    t = F.broadcast(_totals(df, label, score))  # one row
    p = roc_points(df, score, label).crossJoin(t)
    return p.select("threshold", "tp", "fp", (F.col("fp") / F.greatest("n_all", F.lit(1))).alias("fpr"), (F.col("tp") / F.greatest("p_all", F.lit(1))).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def ranking_metrics(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """One row: n, positives, ROC-AUC (ties count half) and average precision; null for one class only."""
    points = roc_points(df, score, label)
    neg = F.col("n") - F.col("pos")
    sums = points.agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_positives"),
        F.sum(neg.cast("double") * (F.col("tp") - F.col("pos")) + neg.cast("double") * F.col("pos") / 2).alias("won"), F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("area"),
    )
    p, m = F.col("n_positives"), F.col("n") - F.col("n_positives")
    both = (p > 0) & (m > 0)
    return sums.select("n", "n_positives", F.when(both, F.col("won") / F.when(both, p.cast("double") * m)).alias("roc_auc"), F.when(p > 0, F.col("area") / F.when(p > 0, p)).alias("pr_auc"))


def ranking_by(df: DataFrame, by: list[str], score: str = "score", label: str = "y", weight: str | None = None) -> DataFrame:
    """(by, n, n_positives, roc_auc, pr_auc) of each group, all groups in one running sum over their distinct scores."""
    w = F.lit(1) if weight is None else F.col(weight)
    counts = df.filter(F.col(score).isNotNull()).groupBy(*by, (-F.col(score)).alias("__s")).agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("pos"))
    held = running(counts.withColumn("__k", F.struct(*by, "__s")), "__k", {"tp": F.col("pos"), "at": F.col("n")})
    base = held.groupBy(*by).agg(F.min(F.col("tp") - F.col("pos")).alias("__tp"), F.min(F.col("at") - F.col("n")).alias("__at"))
    points = held.join(base, by).withColumn("tp", F.col("tp") - F.col("__tp")).withColumn("at", F.col("at") - F.col("__at"))
    neg = (F.col("n") - F.col("pos")).cast("double")
    sums = points.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_positives"), F.sum(neg * (F.col("tp") - F.col("pos")) + neg * F.col("pos") / 2).alias("won"), F.sum(F.col("pos").cast("double") * F.col("tp") / F.col("at")).alias("area"))
    p, m = F.col("n_positives"), F.col("n") - F.col("n_positives")
    both = (p > 0) & (m > 0)
    return sums.select(*by, "n", "n_positives", F.when(both, F.col("won") / F.when(both, p.cast("double") * m)).alias("roc_auc"), F.when(p > 0, F.col("area") / F.when(p > 0, p)).alias("pr_auc"))


def top_k_metrics(df: DataFrame, ks: tuple[int, ...] = (10, 30, 50, 100), score: str = "score", label: str = "is_malicious", keys: tuple[str, ...] = ("user_id", "day")) -> DataFrame:
    """(k, precision, recall) of the k highest scores; ties by key; k is held to the rows there are."""
    top = df.orderBy(F.desc(score), *keys).limit(max(ks)).select(score, *keys, label)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *keys)))  # at most max(ks) rows
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    grid = whole.select("n", "p", F.explode(F.array(*[F.lit(k) for k in ks])).alias("asked")).withColumn("k", F.least("asked", "n").cast("int"))
    hits = F.broadcast(grid).join(ranked, F.col("rank") <= F.col("k"), "left").groupBy("asked", "k", "p").agg(F.sum(label).alias("tp"))
    return hits.select("k", F.col("tp").cast("long").alias("tp"), (F.col("tp") / F.greatest("k", F.lit(1))).alias("precision"), (F.col("tp") / F.greatest("p", F.lit(1))).alias("recall"))


def best_f1(counts: DataFrame, by: list[str] | None = None, tie: str = "low") -> DataFrame:
    """(by, threshold, f1): the score of (by, score, n, pos) with the best F1 of ``score >= threshold``.

    Equal F1 (to 12 digits) goes to the lower score, or with tie='high' the higher.
    """
    if by:
        down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        points = counts.withColumn("tp", F.sum("pos").over(down)).withColumn("__at", F.sum("n").over(down))
        points = points.withColumn("p", F.sum("pos").over(Window.partitionBy(*by)))
    else:
        points = running(counts, "score", {"tp": F.col("pos"), "__at": F.col("n")}, descending=True)
        points = points.crossJoin(F.broadcast(counts.agg(F.sum("pos").alias("p"))))  # one row
    f1 = F.round(2.0 * F.col("tp") / F.greatest(F.col("__at") + F.col("p"), F.lit(1e-9)), 12)
    key = F.struct(f1.alias("f1"), (F.col("score") if tie == "high" else -F.col("score")).alias("s"))
    best = points.groupBy(*(by or [])).agg(F.max(key).alias("best"))
    return best.select(*(by or []), (F.col("best.s") if tie == "high" else -F.col("best.s")).alias("threshold"), F.col("best.f1").alias("f1"))


def best_f1_threshold(df: DataFrame, score: str = "score", label: str = "y", tie: str = "low") -> DataFrame:
    return best_f1(by_score(df, score, label), tie=tie)


def threshold_at_precision(df: DataFrame, least: float = 0.5, score: str = "score", label: str = "y", keys: tuple[str, ...] = ("user_id", "day")) -> DataFrame:
    """The score of the first rank, from the top, at which precision is at least ``least``; else the top positive's, else the top score.

    Ranks within tied scores follow the order of positives first, so the answer is
    that of the best order of the ties and depends on distinct scores only.
    """
    points = roc_points(df, score, label)
    before_tp, before = F.col("tp") - F.col("pos"), F.col("tp") + F.col("fp") - F.col("n")
    reach = F.when(F.col("pos") > 0, F.col("tp") / (before + F.col("pos"))).otherwise(before_tp / (before + 1))
    found = points.agg(F.max(F.when(reach >= least, F.col("threshold"))).alias("a"), F.max(F.when(F.col("pos") > 0, F.col("threshold"))).alias("b"), F.max("threshold").alias("c"))
    return found.select(F.coalesce("a", "b", "c").alias("threshold"))


def scenario_recall(df: DataFrame, scenarios: DataFrame, alert: Column, label: str = "is_malicious") -> DataFrame:
    """(scenario, n_positives, n_detected, recall); recall is null without positives."""
    rows = df.filter(F.col(label) == 1).withColumn("__alert", alert).join(F.broadcast(scenarios.select("user_id", "scenario").distinct()), "user_id")
    found = rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_positives"), F.count_if("__alert").alias("n_detected"))
    return scenarios.select("scenario").distinct().join(found, "scenario", "left").select("scenario", F.coalesce("n_positives", F.lit(0)).alias("n_positives"), F.coalesce("n_detected", F.lit(0)).alias("n_detected"), (F.col("n_detected") / F.col("n_positives")).alias("recall"))


def wilson_table(df: DataFrame, k: str, n: str, z: float = 1.6448536269514722) -> DataFrame:
    lo, hi = wilson(F.col(k), F.col(n), z)
    return df.select("*", lo.alias("ci_low"), hi.alias("ci_high"))


def gini(counts: DataFrame, col: str) -> DataFrame:
    """One row: Gini of non-negative counts, 0 if they sum to 0; from as many rows as there are different counts."""
    by_count = counts.groupBy(F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    placed = by_count.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = F.col("c") * (F.col("before") + (F.col("c") + 1) / 2.0)  # sum of the ranks of one count
    s = placed.agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("x") * F.col("c")).cast("double").alias("t"), F.sum(ranks * F.col("x")).alias("w"))
    return s.select(F.when(F.col("t") > 0, 2 * F.col("w") / F.when(F.col("t") > 0, F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")).otherwise(F.lit(0.0)).alias("gini"))


def user_diagnostics(df: DataFrame, high: float = 0.5, score: str = "score", label: str = "is_malicious", mask: str = "alert") -> DataFrame:
    """Of each user: days, highest, mean and top-three mean score, days over ``high``, alerts, label.

    Scores are added up as decimals of nine digits, so a mean doesn't depend on the order of its rows.
    """
    exact = F.col(score).cast("decimal(18,9)")
    top = F.slice(F.sort_array(F.collect_list(exact), asc=False), 1, 3)  # a user has one score a day
    return df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.max(score).alias("max_score"), F.sum(exact).cast("double").alias("__sum"),
        F.aggregate(top, F.lit(0).cast("decimal(28,9)"), lambda a, x: (a + x).cast("decimal(28,9)")).cast("double").alias("__top"),
        F.count_if(F.col(score) >= high).alias("high_days"), F.count_if(F.col(mask)).alias("n_alerts"), F.max(label).alias("label"),
    ).withColumn("mean_score", F.col("__sum") / F.col("n_days")).withColumn("top3_mean", F.col("__top") / F.least("n_days", F.lit(3))).drop("__top", "__sum")


USER_SCORES = ["max_score", "mean_score", "top3_mean", "high_days", "n_alerts"]


def user_level_auc(users: DataFrame) -> DataFrame:
    """(statistic, roc_auc) of each statistic of :func:`user_diagnostics` as a score of the user's label, and as ``precision_at_5`` the share of malicious users among the five with the highest score (ties to the smaller user)."""
    parts = [ranking_metrics(users.select(F.col(s).cast("double").alias("score"), "label"), label="label").select(F.lit(s).alias("statistic"), "roc_auc") for s in USER_SCORES]
    top = users.orderBy(F.desc("max_score"), "user_id").limit(5).agg(F.avg("label").alias("roc_auc")).select(F.lit("precision_at_5").alias("statistic"), "roc_auc")
    return reduce(DataFrame.unionByName, parts).unionByName(top)


def detection(df: DataFrame, label: str = "is_malicious", mask: str = "alert") -> DataFrame:
    """Of each malicious user: onset, first alert on a malicious day, delay in days, its ordinal among malicious days, detected days."""
    bad = df.filter(F.col(label) == 1).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    hit = F.col(mask)
    found = bad.groupBy("user_id").agg(F.min("day").alias("onset"), F.count(F.lit(1)).alias("n_days"), F.min(F.when(hit, F.col("day"))).alias("first_alert"), F.min(F.when(hit, F.col("rank"))).alias("alert_rank"), F.count_if(hit).alias("n_detected"))
    return found.withColumn("delay", F.datediff("first_alert", "onset")).withColumn("detected", F.col("n_detected") > 0).withColumn("fully_detected", F.col("n_detected") == F.col("n_days")).withColumn("first_week", F.coalesce(F.col("delay") < 7, F.lit(False)))


def coverage(found: DataFrame) -> DataFrame:
    """One row over :func:`detection`: users, detected, fully detected, none, share and its Wilson interval."""
    one = found.agg(F.count(F.lit(1)).alias("n_users"), F.count_if("detected").alias("n_detected"), F.count_if("fully_detected").alias("n_full"), F.count_if(~F.col("detected")).alias("n_missed"), F.avg("delay").alias("mean_delay"))
    return wilson_table(one.withColumn("share", F.col("n_detected") / F.greatest("n_users", F.lit(1))), "n_detected", "n_users")


def coverage_by_strata(found: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n_users, n_detected) of each stratum, in one pass by grouping sets."""
    sets = [[F.col(f)] for f in fields]
    rows = found.groupingSets(sets, *[F.col(f) for f in fields]).agg(F.grouping_id(*fields).alias("__g"), F.count(F.lit(1)).alias("n_users"), F.count_if("detected").alias("n_detected"))
    full = (1 << len(fields)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, f in enumerate(fields):
        own = F.col("__g") == full - (1 << (len(fields) - 1 - i))
        name, value = F.when(own, F.lit(f)).otherwise(name), F.when(own, F.col(f).cast("string")).otherwise(value)
    return rows.select(name.alias("field"), value.alias("value"), "n_users", "n_detected")


def tie_audit(df: DataFrame, score: str = "score", caution: float = 0.01) -> DataFrame:
    """One row: distinct scores, rows that share theirs, their share, and whether that is over ``caution``."""
    c = df.groupBy(score).agg(F.count(F.lit(1)).alias("c"))
    one = c.agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("n_tied"))
    return one.withColumn("tied_share", F.col("n_tied") / F.greatest("n", F.lit(1))).withColumn("caution", F.col("tied_share") > caution)


def near_threshold(df: DataFrame, t: float, widths: tuple[float, ...] = (0.05, 0.1, 0.2), score: str = "score", label: str = "is_malicious") -> DataFrame:
    """(width, n_near_misses, n_near_false): malicious rows just below, benign rows just at or above the threshold."""
    s, y = F.col(score), F.col(label) == 1
    row = df.agg(*[F.count_if(y & (s < t) & (s >= t - w)).alias(f"m{i}") for i, w in enumerate(widths)], *[F.count_if(~y & (s >= t) & (s < t + w)).alias(f"f{i}") for i, w in enumerate(widths)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.col(f"m{i}").alias("n_near_misses"), F.col(f"f{i}").alias("n_near_false")) for i, w in enumerate(widths)])).alias("x")).select("x.*")


def kendall_tau(a: DataFrame, b: DataFrame, item: str = "item", value: str = "value") -> DataFrame:
    """One row: Kendall's tau-a of two rankings of a few items."""
    both = a.select(item, F.col(value).alias("x")).join(b.select(item, F.col(value).alias("y")), item)
    l, r = both.toDF("i", "x1", "y1"), both.toDF("j", "x2", "y2")
    pairs = l.join(r, F.col("i") < F.col("j"))  # pairs of a fixed list of features
    return pairs.agg((F.sum(F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))) / F.count(F.lit(1))).alias("tau"))


def raw_threshold(df: DataFrame, t: float, mapped: str = "p", raw: str = "score") -> DataFrame:
    """One row: the smallest raw score whose mapped score reaches the threshold; null if none does."""
    return df.filter(F.col(mapped) >= t).agg(F.min(raw).alias("raw_threshold"))


def window_intervals(df: DataFrame, label: str = "is_malicious", mask: str = "alert") -> DataFrame:
    """(window, n_alerts, n_positives, tp, and Wilson intervals of precision and recall) of each window; null without alerts or positives."""
    rows = binary_metrics(df, F.col(mask), F.col(label), ["window"]).select("window", "n_alerts", "n_positives", "tp")
    p, r = wilson(F.col("tp"), F.col("n_alerts")), wilson(F.col("tp"), F.col("n_positives"))
    return rows.withColumns({"precision_low": p[0], "precision_high": p[1], "recall_low": r[0], "recall_high": r[1]})
