"""Bootstrap intervals by hashed Poisson weights, folds and allocations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.sources.scratch import written


def poisson_weight(key: list[str], replicate: str, seed: int = 42, most: int = 12) -> Column:
    """A Poisson(1) count from a hash of the key and replicate: one key has one count in a replicate on every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), *key, replicate), F.lit(1 << 52)).cast("double") / float(1 << 52)
    total, cuts = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(total)
    return sum(((u >= c).cast("int") for c in cuts), F.lit(0))


def replicates(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """``df`` with ``replicate`` and ``w``: rows of weight 0 are left out; the key decides what is drawn together."""
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.withColumn("w", poisson_weight(key, "replicate", seed)).filter("w > 0")


def _auc(df: DataFrame, scores: list[str], label: str) -> DataFrame:
    """(replicate, model, roc_auc, pr_auc) of weighted rows."""
    models = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("s")) for s in scores]))
    counts = df.select("replicate", "w", F.col(label).alias("y"), models.alias("m")).groupBy("replicate", "m.model", "m.s").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos"))
    down = Window.partitionBy("replicate", "model").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    points = counts.withColumn("tp", F.sum("pos").over(down)).withColumn("at", F.sum("n").over(down))
    neg = F.col("n") - F.col("pos")
    sums = points.groupBy("replicate", "model").agg(F.sum("pos").alias("p"), F.sum(neg).alias("m"), F.sum(neg * (F.col("tp") - F.col("pos") / 2.0)).alias("won"), F.sum(F.col("pos") * F.col("tp") / F.col("at")).alias("area"))
    return sums.filter("p > 0 and m > 0").select("replicate", "model", (F.col("won") / (F.col("p") * F.col("m"))).alias("roc_auc"), (F.col("area") / F.col("p")).alias("pr_auc"))


def bootstrap_ci(df: DataFrame, n: int = 200, key: tuple[str, ...] = ("user_id", "day"), score: str = "score", label: str = "is_malicious", alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(metric, n_valid, ci_low, ci_high) of ROC-AUC and average precision; the key is the row, or the user for blocks."""
    values = _auc(replicates(df, n, list(key), seed), [score], label).unpivot(["replicate", "model"], ["roc_auc", "pr_auc"], "metric", "value")
    return values.groupBy("metric").agg(F.count(F.lit(1)).alias("n_valid"), F.percentile("value", alpha / 2).alias("ci_low"), F.percentile("value", 1 - alpha / 2).alias("ci_high"))


def paired_delta(df: DataFrame, base: str, new: str, n: int = 200, key: tuple[str, ...] = ("user_id", "day"), label: str = "is_malicious", alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(metric, n_valid, mean, ci_low, ci_high, share_positive) of new minus base on the same draws."""
    long = _auc(replicates(df, n, list(key), seed), [base, new], label).unpivot(["replicate", "model"], ["roc_auc", "pr_auc"], "metric", "value")
    d = long.groupBy("replicate", "metric").agg((F.sum(F.when(F.col("model") == new, F.col("value"))) - F.sum(F.when(F.col("model") == base, F.col("value")))).alias("d"))
    return d.groupBy("metric").agg(F.count("d").alias("n_valid"), F.avg("d").alias("mean"), F.percentile("d", alpha / 2).alias("ci_low"), F.percentile("d", 1 - alpha / 2).alias("ci_high"), F.avg((F.col("d") > 0).cast("int")).alias("share_positive"))


def operating_ci(df: DataFrame, n: int = 200, key: tuple[str, ...] = ("user_id",), mask: str = "alert", label: str = "is_malicious", alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(metric, ci_low, ci_high) of precision, recall and F1 at a fixed mask."""
    a, y, w = F.col(mask), F.col(label) == 1, F.col("w")
    count = lambda c: F.sum(F.when(c, w).otherwise(0))
    c = replicates(df, n, list(key), seed).groupBy("replicate").agg(count(a & y).alias("tp"), count(a & ~y).alias("fp"), count(~a & y).alias("fn"))
    m = c.select((F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"), (2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))).alias("f1"))
    return m.unpivot([], ["precision", "recall", "f1"], "metric", "value").groupBy("metric").agg(F.percentile("value", alpha / 2).alias("ci_low"), F.percentile("value", 1 - alpha / 2).alias("ci_high"))


def threshold_ci(df: DataFrame, n: int = 200, key: tuple[str, ...] = ("user_id", "day"), score: str = "score", label: str = "is_malicious", alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: interval of the best-F1 threshold over replicates; ties go to the higher score here."""
    from vigilake.operators.metrics import best_f1

    counts = replicates(df, n, list(key), seed).groupBy("replicate", F.col(score).alias("score")).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col(label)).alias("pos"))
    t = best_f1(counts, ["replicate"], tie="high").filter("f1 > 0")
    return t.agg(F.count(F.lit(1)).alias("n_valid"), F.percentile("threshold", alpha / 2).alias("ci_low"), F.percentile("threshold", 1 - alpha / 2).alias("ci_high")).withColumn("ci_width", F.col("ci_high") - F.col("ci_low"))


def round_robin(users: DataFrame, folds: int) -> DataFrame:
    """(user_id, fold): rank of the user modulo the folds. Ranks come from running counts, so no task holds all users."""
    from vigilake.operators.ordered import running

    own = users.select("user_id").distinct()
    return running(own, "user_id", {"rank": F.lit(1)}).select("user_id", ((F.col("rank") - 1) % folds).cast("int").alias("fold"))


def round_robin_by(users: DataFrame, folds: int, by: list[str]) -> DataFrame:
    """(by, user_id, fold): :func:`round_robin` within each group of distinct users, all groups in one running count."""
    from vigilake.operators.ordered import running

    held = running(users.select(*by, "user_id").distinct().withColumn("__key", F.struct(*by, "user_id")), "__key", {"rank": F.lit(1)})
    first = held.groupBy(*by).agg(F.min("rank").alias("__first"))
    return held.join(F.broadcast(first), by).select(*by, "user_id", ((F.col("rank") - F.col("__first")) % folds).cast("int").alias("fold"))  # a row each group


def allocate(df: DataFrame, label: str = "is_malicious") -> DataFrame:
    """(user_id, malicious, block): malicious users by (first bad day, id) modulo 14 into 8, 3 and 3; others by id modulo 10 into 8, 1 and 1."""
    from vigilake.operators.ordered import running

    users = df.groupBy("user_id").agg(F.max(label).alias("malicious"), F.min(F.when(F.col(label) == 1, F.col("day"))).alias("onset"))
    users = written(users, "users")
    good = running(users.filter("malicious = 0").select("user_id"), "user_id", {"r": F.lit(1)}).select("user_id", F.lit(0).alias("malicious"), ((F.col("r") - 1) % 10).alias("m"))
    bad = users.filter("malicious = 1")
    days = running(bad.groupBy(F.datediff("onset", F.lit("1970-01-01").cast("date")).alias("d")).agg(F.count(F.lit(1)).alias("c")), "d", {"upto": F.col("c")}).select("d", (F.col("upto") - F.col("c")).alias("before"))
    own = F.row_number().over(Window.partitionBy("onset").orderBy("user_id"))
    bad = bad.withColumn("d", F.datediff("onset", F.lit("1970-01-01").cast("date"))).join(F.broadcast(days), "d").select("user_id", F.lit(1).alias("malicious"), ((own + F.col("before") - 1) % 14).alias("m"))
    block = F.when(F.col("m") < 8, "train").when(F.when(F.col("malicious") == 1, F.col("m") < 11).otherwise(F.col("m") < 9), "calibration").otherwise("test")
    return bad.unionByName(good).select("user_id", "malicious", block.alias("block"))


def disjoint(allocation: DataFrame) -> DataFrame:
    """One row: users in more than one block."""
    return allocation.groupBy("user_id").agg(F.countDistinct("block").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_shared"))


def platt_refit(calibration: DataFrame, test: DataFrame, n: int = 100, key: tuple[str, ...] = ("user_id",), score: str = "score", label: str = "is_malicious", alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(metric, n_valid, ci_low, ci_high) of slope, intercept and test Brier score, the logistic curve refitted on every replicate.

    Each replicate is one group of distinct scores with their weights.
    """
    import numpy as np
    import pandas as pd

    def counts(df: DataFrame, side: str) -> DataFrame:
        drawn = replicates(df, n, list(key), seed).groupBy("replicate", F.col(score).cast("double").alias("s"))
        return drawn.agg(F.sum("w").cast("double").alias("n"), F.sum(F.col("w") * F.col(label)).cast("double").alias("k")).withColumn("side", F.lit(side))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cal, new = pdf[pdf.side == "cal"], pdf[pdf.side == "test"]
        none = pd.DataFrame({"metric": [], "value": []}).astype({"metric": str, "value": float})
        if not 0 < cal.k.sum() < cal.n.sum() or not len(new):
            return none
        x, w = np.stack([cal.s.to_numpy(), np.ones(len(cal))], axis=1), np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (cal.n.to_numpy() * p - cal.k.to_numpy()) + np.array([w[0], 0])
            h = (x * (cal.n.to_numpy() * p * (1 - p))[:, None]).T @ x + np.diag([1.0, 1e-9])
            w = w - np.linalg.solve(h, g)
        p = 1 / (1 + np.exp(-np.clip(w[0] * new.s.to_numpy() + w[1], -30, 30)))
        brier = (new.k * (1 - p) ** 2 + (new.n - new.k) * p**2).sum() / new.n.sum()
        return pd.DataFrame({"metric": ["slope", "intercept", "brier"], "value": [w[0], w[1], brier]})

    both = counts(calibration, "cal").unionByName(counts(test, "test"))
    values = both.groupBy("replicate").applyInPandas(fit, "metric string, value double")
    return values.groupBy("metric").agg(F.count("value").alias("n_valid"), F.percentile("value", alpha / 2).alias("ci_low"), F.percentile("value", 1 - alpha / 2).alias("ci_high"))


def _bin_rates(s, n, k, x, bins: int = 20):
    """Rates of quantile bins of weighted scores, pooled until they rise, at ``x``."""
    import numpy as np

    order = np.argsort(s)
    s, n, k = s[order], n[order], k[order]
    upto = np.cumsum(n)
    cuts = np.unique(s[np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins)])
    place = np.searchsorted(cuts, s, side="left")
    pools: list[list[float]] = []
    for b in np.unique(place):
        own = place == b
        pools.append([s[own].max(), n[own].sum(), k[own].sum()])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] > pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    tops, rates = np.array([p[0] for p in pools]), np.array([p[2] / p[1] for p in pools])
    return rates[np.minimum(np.searchsorted(tops, x, side="left"), len(rates) - 1)]


def _mid_ranks(s, n, k, x):
    """Mid-rank percentiles of ``x`` among weighted scores."""
    import numpy as np

    order = np.argsort(s)
    s, upto = s[order], np.concatenate(([0.0], np.cumsum(n[order])))
    below, at = upto[np.searchsorted(s, x, side="left")], upto[np.searchsorted(s, x, side="right")]
    return np.clip(((below + at) / 2 - 0.5) / upto[-1], 0, 1)


MAPS = {"bins": _bin_rates, "ecdf": _mid_ranks}


def map_refit(calibration: DataFrame, test: DataFrame, method: str, n: int = 100, key: tuple[str, ...] = ("user_id",), score: str = "score", label: str = "is_malicious", alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(metric, n_valid, ci_low, ci_high) of the test Brier score and mean forecast, the map (bins or ecdf) refitted on every replicate.

    Each replicate is one group of distinct scores with their weights.
    """
    import pandas as pd

    def counts(df: DataFrame, side: str) -> DataFrame:
        drawn = replicates(df, n, list(key), seed).groupBy("replicate", F.col(score).cast("double").alias("s"))
        return drawn.agg(F.sum("w").cast("double").alias("n"), F.sum(F.col("w") * F.col(label)).cast("double").alias("k")).withColumn("side", F.lit(side))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cal, new = pdf[pdf.side == "cal"], pdf[pdf.side == "test"]
        if not len(cal) or not len(new):
            return pd.DataFrame({"metric": [], "value": []}).astype({"metric": str, "value": float})
        p = MAPS[method](cal.s.to_numpy(), cal.n.to_numpy(), cal.k.to_numpy(), new.s.to_numpy())
        k, m = new.k.to_numpy(), new.n.to_numpy()
        return pd.DataFrame({"metric": ["brier", "mean_p"], "value": [(k * (1 - p) ** 2 + (m - k) * p**2).sum() / m.sum(), (m * p).sum() / m.sum()]})

    values = counts(calibration, "cal").unionByName(counts(test, "test")).groupBy("replicate").applyInPandas(fit, "metric string, value double")
    return values.groupBy("metric").agg(F.count("value").alias("n_valid"), F.percentile("value", alpha / 2).alias("ci_low"), F.percentile("value", 1 - alpha / 2).alias("ci_high"))
