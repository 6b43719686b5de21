"""Conformal sets, reliability and calibration maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.scalar import sigmoid
from vigilake.operators.ordered import running

ALPHAS = (0.01, 0.05, 0.10, 0.20)


def check_alpha(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie in (0, 1)")
    return alpha


def conformal_p(calibration: DataFrame, scored: DataFrame, score: str = "score", label: str = "is_malicious") -> DataFrame:
    """``scored`` with p1 = (# positives <= s, + 1) / (n1 + 1) and p0 = (# negatives >= s, + 1) / (n0 + 1), ties included.

    Both tables meet as distinct scores: running counts of the calibration
    scores are taken over the union of values and joined back by score.
    """
    cal = calibration.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("c1"), (F.count(F.lit(1)) - F.sum(label)).alias("c0"))
    asked = scored.select(F.col(score).alias("s")).distinct().select("s", F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c0"))
    values = cal.unionByName(asked).groupBy("s").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    upto = running(values, "s", {"le1": F.col("c1"), "le0": F.col("c0")})
    n = calibration.agg(F.coalesce(F.sum(label), F.lit(0)).alias("n1"), (F.count(F.lit(1)) - F.coalesce(F.sum(label), F.lit(0))).alias("n0"))
    p = upto.crossJoin(F.broadcast(n)).select(F.col("s").alias("__s"), ((F.col("le1") + 1) / (F.col("n1") + 1)).alias("p1"), ((F.col("n0") - F.col("le0") + F.col("c0") + 1) / (F.col("n0") + 1)).alias("p0"))
    return scored.join(p, F.col(score) == F.col("__s"), "left").drop("__s")


def set_category(p1: Column, p0: Column, alpha: float) -> Column:
    check_alpha(alpha)
    a, b = p1 > alpha, p0 > alpha
    return F.when(a & b, "{0,1}").when(a, "{1}").when(b, "{0}").otherwise("{}")


def confidence(category: Column, alpha: float) -> Column:
    return F.when(category.isin("{0}", "{1}"), F.lit(1 - alpha)).when(category == "{0,1}", F.lit(1 - 2 * alpha)).otherwise(F.lit(0.0))


def coverage(df: DataFrame, alphas: tuple[float, ...] = ALPHAS, label: str = "is_malicious") -> DataFrame:
    """(alpha, n, coverage, coverage_pos, coverage_neg, n_single, n_both, n_empty) of a frame with p1 and p0, all alphas in one pass."""
    y = F.col(label) == 1
    stats = []
    for i, alpha in enumerate(alphas):
        c = set_category(F.col("p1"), F.col("p0"), alpha)
        hit = F.when(y, F.col("p1") > alpha).otherwise(F.col("p0") > alpha).cast("int")
        stats += [
            F.avg(hit).alias(f"coverage_{i}"), F.avg(F.when(y, hit)).alias(f"coverage_pos_{i}"), F.avg(F.when(~y, hit)).alias(f"coverage_neg_{i}"),
            F.count_if(c.isin("{0}", "{1}")).alias(f"n_single_{i}"), F.count_if(c == "{0,1}").alias(f"n_both_{i}"), F.count_if(c == "{}").alias(f"n_empty_{i}"),
        ]
    names = ["coverage", "coverage_pos", "coverage_neg", "n_single", "n_both", "n_empty"]
    row = df.agg(F.count(F.lit(1)).alias("n"), *stats)
    each = [F.struct(F.lit(a).alias("alpha"), F.col("n"), *[F.col(f"{x}_{i}").alias(x) for x in names]) for i, a in enumerate(alphas)]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def crosstab(df: DataFrame, alpha: float = 0.05, mask: str = "alert", label: str = "is_malicious") -> DataFrame:
    """(alert, category, n, n_pos, precision) with totals by cube."""
    rows = df.withColumn("category", set_category(F.col("p1"), F.col("p0"), alpha)).withColumnRenamed(mask, "__alert").withColumn("alert", F.col("__alert"))
    return rows.cube("alert", "category").agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("n_pos"), F.avg(label).alias("precision"))


def inclusion_thresholds(calibration: DataFrame, alpha: float, score: str = "score", label: str = "is_malicious") -> DataFrame:
    """(k1, t1, k0, t0): the order statistics that bound each class's inclusion; infinite where k is 0.

    1 is in the set for s >= t1 and 0 for s <= t0: more than alpha * (n + 1) - 1
    calibration scores of the class must lie on the other side.
    """
    check_alpha(alpha)
    n = calibration.agg(F.sum(label).alias("n1"), (F.count(F.lit(1)) - F.sum(label)).alias("n0"))
    k = n.select(F.floor(F.lit(alpha) * (F.col("n1") + 1)).alias("k1"), F.floor(F.lit(alpha) * (F.col("n0") + 1)).alias("k0"))
    counts = calibration.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("c1"), (F.count(F.lit(1)) - F.sum(label)).alias("c0"))
    up = running(counts, "s", {"le1": F.col("c1")}).crossJoin(F.broadcast(k)).agg(F.first("k1").alias("k1"), F.min(F.when((F.col("le1") >= F.col("k1")) & (F.col("k1") > 0), F.col("s"))).alias("t1"))
    down = running(counts, "s", {"ge0": F.col("c0")}, descending=True).crossJoin(F.broadcast(k)).agg(F.first("k0").alias("k0"), F.max(F.when((F.col("ge0") >= F.col("k0")) & (F.col("k0") > 0), F.col("s"))).alias("t0"))
    inf = float("inf")
    return up.crossJoin(down).select("k1", F.coalesce("t1", F.lit(-inf)).alias("t1"), "k0", F.coalesce("t0", F.lit(inf)).alias("t0"))


def brier(df: DataFrame, p: str = "p", label: str = "y") -> DataFrame:
    return df.agg(F.avg((F.col(p) - F.col(label)) * (F.col(p) - F.col(label))).alias("brier"))


def _rank_bins(df: DataFrame, p: str, keys: tuple[str, ...], bins: int) -> DataFrame:
    """``df`` with ``bin``, as ntile over (p, keys): ranks from running counts of p; only rows with one p are ranked together."""
    counts = df.groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    before = running(counts, "__p", {"__upto": F.col("__c")}).withColumn("__before", F.col("__upto") - F.col("__c")).select("__p", "__before")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    own = F.row_number().over(Window.partitionBy(p).orderBy(*keys))
    held = df.join(before, F.col(p) == F.col("__p")).withColumn("__r", own + F.col("__before")).crossJoin(F.broadcast(n))
    size, extra = F.floor(F.col("__n") / bins), F.col("__n") % bins
    first = extra * (size + 1)
    bin_ = F.when(F.col("__r") <= first, F.floor((F.col("__r") - 1) / (size + 1))).otherwise(extra + F.floor((F.col("__r") - 1 - first) / F.greatest(size, F.lit(1)))) + 1
    return held.withColumn("bin", bin_.cast("int")).drop("__p", "__before", "__r", "__n")


def reliability(df: DataFrame, bins: int = 10, p: str = "p", label: str = "y", keys: tuple[str, ...] = ("user_id", "day")) -> DataFrame:
    """(bin, n, mean_p, rate): bins of near-equal counts in the order of p, larger ones first."""
    return _rank_bins(df, p, keys, bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("rate"))


def ece(rows: DataFrame) -> DataFrame:
    """One row from :func:`reliability`: the mean gap between forecast and rate, weighted by rows."""
    return rows.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def quantile_bins(df: DataFrame, k: int = 20, score: str = "score", label: str = "y") -> DataFrame:
    """(bin, lo, hi, n, pos) of ``k`` quantile bins of the score; equal edges are one."""
    cuts = df.agg(F.array_distinct(F.percentile(score, F.array(*[F.lit(i / k) for i in range(1, k)]))).alias("cuts"))
    b = F.size(F.filter("cuts", lambda c: c < F.col(score)))
    return df.crossJoin(F.broadcast(cuts)).withColumn("bin", b).groupBy("bin").agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))


def fit_bins(df: DataFrame, k: int = 20, least: int = 30, fewest: int = 5, score: str = "score", label: str = "y") -> list[tuple[float, float]]:
    """(upper edge, rate) of monotone bins: small bins join the smaller neighbour (left if equal), then adjacent violators are pooled.

    At most ``k`` rows reach the driver.
    """
    rows = [[r["hi"], r["n"], r["pos"]] for r in quantile_bins(df, k, score, label).orderBy("bin").collect()]
    while len(rows) > 1 and min(r[1] for r in rows) < least:
        i = min(range(len(rows)), key=lambda j: (rows[j][1], j))
        sides = [j for j in (i - 1, i + 1) if 0 <= j < len(rows)]
        j = min(sides, key=lambda s: (rows[s][1], s))
        a, b = sorted((i, j))
        rows[a : b + 1] = [[rows[b][0], rows[a][1] + rows[b][1], rows[a][2] + rows[b][2]]]
    if len(rows) < fewest:
        raise ValueError(f"only {len(rows)} bins of {least} rows")
    pools: list[list[float]] = []
    for r in rows:
        pools.append(list(r))
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] > pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return [(p[0], p[2] / p[1]) for p in pools]


def apply_bins(score: Column, bins: list[tuple[float, float]]) -> Column:
    return reduce(lambda rest, b: F.when(score <= b[0], F.lit(b[1])).otherwise(rest), reversed(bins[:-1]), F.lit(bins[-1][1]))


def fit_platt(df: DataFrame, score: str = "score", label: str = "y", c: float = 1.0, steps: int = 25) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps; each takes five sums over distinct scores."""
    import numpy as np

    counts = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("k")).cache()
    w = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(F.lit(float(w[0])) * F.col("s") + F.lit(float(w[1])), 30.0)
        g, h = F.col("n") * p - F.col("k"), F.col("n") * p * (1 - p)
        r = counts.agg(F.sum(g * F.col("s")), F.sum(g), F.sum(h * F.col("s") * F.col("s")), F.sum(h * F.col("s")), F.sum(h)).first()
        grad = np.array([r[0] + w[0] / c, r[1]])
        move = np.linalg.solve(np.array([[r[2] + 1 / c, r[3]], [r[3], r[4] + 1e-9]]), grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    counts.unpersist()
    if w[0] <= 0:
        raise ValueError("the slope is not positive")
    return float(w[0]), float(w[1])
