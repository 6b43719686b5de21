"""Distributions: summaries, empirical CDFs, shifts between cohorts, correlations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.scalar import activity_bucket
from vigilake.operators.ordered import running


def summarise(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mean, std, min, max, cv) of each column."""
    stat = lambda c: F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"))
    rows = df.agg(F.array(*[stat(c) for c in cols]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return rows.withColumn("cv", F.col("std") / F.when(F.col("mean") != 0, F.abs("mean")))


def unpivot(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value) as doubles."""
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, features, "feature", "value")


def cdf_grid(train: DataFrame, col: str, steps: int = 1000) -> DataFrame:
    """One row with the ``steps`` + 1 quantiles of a column: a fitted empirical CDF."""
    return train.agg(F.percentile(col, F.array(*[F.lit(i / steps) for i in range(steps + 1)])).alias("grid"))


def cdf_value(grid: Column, x: Column, steps: int = 1000) -> Column:
    """Linear interpolation of x on a quantile grid, within [0, 1]; a run of equal quantiles counts as its last."""
    below = F.size(F.filter(grid, lambda g: g <= x))  # the grid is short and ordered
    lo, hi = F.get(grid, below - 1), F.get(grid, below)
    inside = (F.lit(1.0) * (below - 1) + (x - lo) / (hi - lo)) / steps
    return F.when(x.isNull(), None).when(below == 0, F.lit(0.0)).when(below > steps, F.lit(1.0)).otherwise(inside)


def ecdf(train: DataFrame, new: DataFrame, col: str, out: str = "p", clip: bool = True, n_train: int | None = None) -> DataFrame:
    """``new`` with the mid-rank percentile of ``col`` among the training values: ((# < v) + (# <= v)) / 2 - 1/2 over their number.

    Both meet as distinct values, so neither a row nor a value is copied around.
    """
    old = train.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    asked = new.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v")).distinct().withColumn("c", F.lit(0).cast("long"))
    upto = running(old.unionByName(asked).groupBy("v").agg(F.sum("c").alias("c")), "v", {"hi": F.col("c")})
    n = F.broadcast(old.agg(F.sum("c").alias("n"))) if n_train is None else None
    p = ((F.col("hi") - F.col("c") + F.col("hi")) / 2.0 - 0.5) / (F.col("n") if n is not None else F.lit(float(n_train)))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) if clip else p
    values = (upto.crossJoin(n) if n is not None else upto).select(F.col("v").alias("__v"), p.alias(out))  # one row
    return new.join(values, F.col(col).cast("double") == F.col("__v"), "left").drop("__v")


def cohen_d(df: DataFrame, value: str, cohort: str, a, b) -> DataFrame:
    """One row: effect size of cohort ``a`` against ``b`` by the pooled deviation; null if that is 0 or a side has under two rows."""
    own = lambda c: F.when(F.col(cohort) == c, F.col(value).cast("double"))
    s = df.agg(*[f(own(c)).alias(f"{n}{i}") for i, c in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    fits = (F.col("n0") >= 2) & (F.col("n1") >= 2) & (F.col("v0") + F.col("v1") > 0)
    return s.select(F.when(fits, (F.col("m0") - F.col("m1")) / F.when(fits, pooled)).alias("cohen_d"))


def ks(df: DataFrame, value: str, cohort: str, a, b) -> DataFrame:
    """One row: the largest gap between two cohorts' distribution functions, their sizes and the asymptotic p."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(F.col(cohort) == a).alias("a"), F.count_if(F.col(cohort) == b).alias("b"))
    upto = running(counts, "v", {"ca": F.col("a"), "cb": F.col("b")})
    n = F.broadcast(counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))
    gap = upto.crossJoin(n).agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"), F.first("na").alias("n_a"), F.first("nb").alias("n_b"))
    root = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")).cast("double"))
    lam = (root + 0.12 + 0.11 / root) * F.col("ks")
    tail = reduce(lambda s, k: s + (-1.0) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam), range(1, 101), F.lit(0.0))
    return gap.withColumn("p_value", F.when(lam < 0.3, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * tail))))


def psi(df: DataFrame, value: str, cohort: str, reference, actual, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """One row: population stability index over the reference's quantile bins; rows outside its range stay in the denominators only."""
    ref = df.filter(F.col(cohort) == reference)
    edges = ref.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("edges"))
    rows = df.filter(F.col(cohort).isin(reference, actual) & F.col(value).isNotNull()).crossJoin(F.broadcast(edges))  # one row
    v, last = F.col(value).cast("double"), F.element_at("edges", -1)
    inside = (v >= F.element_at("edges", 1)) & (v <= last)
    b = F.when(inside, F.least(F.size(F.filter("edges", lambda e: e <= v)), F.size("edges") - 1))
    per = rows.withColumn("b", b).groupBy("b").agg(F.count_if(F.col(cohort) == reference).alias("r"), F.count_if(F.col(cohort) == actual).alias("a"))
    n = per.agg(F.sum("r").alias("nr"), F.sum("a").alias("na"))
    every = edges.select(F.explode(F.sequence(F.lit(1), F.greatest(F.size("edges") - 1, F.lit(1)))).alias("b")).join(per, "b", "left").crossJoin(n)
    e, o = (F.greatest(F.coalesce(F.col(x), F.lit(0)) / F.col(m), F.lit(floor)) for x, m in (("r", "nr"), ("a", "na")))
    return every.agg(F.sum((o - e) * F.log(o / e)).alias("psi"))


def shift(df: DataFrame, features: list[str], cohort: str) -> DataFrame:
    """(feature, cohort, n, median, p90, mad, zero_share) of all features and cohorts."""
    rows = unpivot(df, [cohort], features).filter("value is not null")
    median = rows.groupBy("feature", cohort).agg(F.percentile("value", 0.5).alias("median"))
    held = rows.join(F.broadcast(median), ["feature", cohort])
    return held.groupBy("feature", cohort).agg(
        F.count(F.lit(1)).alias("n"), F.first("median").alias("median"), F.percentile("value", 0.9).alias("p90"), F.percentile(F.abs(F.col("value") - F.col("median")), 0.5).alias("mad"), F.avg((F.col("value") == 0).cast("int")).alias("zero_share")
    )


def mid_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the mean rank of each row's value among all rows."""
    counts = df.groupBy(F.col(col).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranks = running(counts, "__v", {"__upto": F.col("__c")}).select("__v", (F.col("__upto") - (F.col("__c") - 1) / 2.0).alias(out))
    return df.join(ranks, F.col(col).cast("double") == F.col("__v")).drop("__v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    return mid_ranks(mid_ranks(df, a, "__ra"), b, "__rb").agg(F.corr("__ra", "__rb").alias("spearman"))


def point_biserial(df: DataFrame, col: str, label: str) -> DataFrame:
    return df.agg(F.corr(F.col(col).cast("double"), F.col(label).cast("double")).alias("r"))


def decile_shares(df: DataFrame, col: str, label: str) -> DataFrame:
    """(decile, n, n_pos, share) by the column's decile edges."""
    edges = df.agg(F.percentile(col, F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("edges"))
    d = F.size(F.filter("edges", lambda e: e < F.col(col))) + 1
    return df.crossJoin(F.broadcast(edges)).groupBy(d.alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("n_pos"), F.avg(label).alias("share"))


def activity_strata(df: DataFrame, label: str = "is_malicious", mask: str = "alert") -> DataFrame:
    """(bucket, n_users, n_detected, missed_days, n_alerts) by each malicious user's number of malicious days; all buckets."""
    y = F.col(label) == 1
    users = df.groupBy("user_id").agg(F.count_if(y).alias("n"), F.count_if(y & F.col(mask)).alias("hit"), F.count_if(F.col(mask)).alias("alerts")).filter("n > 0")
    found = users.groupBy(activity_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_users"), F.count_if(F.col("hit") > 0).alias("n_detected"), F.sum(F.col("n") - F.col("hit")).alias("missed_days"), F.sum("alerts").alias("n_alerts"))
    every = df.sparkSession.createDataFrame([(b,) for b in ("1", "2-5", "6-12", "13-44", "45-100", "101+")], "bucket string")
    return every.join(found, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_users", "n_detected", "missed_days", "n_alerts")])


def user_level(df: DataFrame, features: list[str]) -> DataFrame:
    return df.groupBy("user_id").agg(*[F.percentile(f, 0.5).alias(f) for f in features])


def detected_profile(df: DataFrame, found: DataFrame, sums: list[str], means: list[str]) -> DataFrame:
    """(detected, feature, median, lo, hi): users' totals and means, compared between detected and missed users."""
    users = df.join(F.broadcast(found.select("user_id", "detected")), "user_id").groupBy("user_id", "detected").agg(*[F.sum(c).cast("double").alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])
    return unpivot(users, ["user_id", "detected"], sums + means).groupBy("detected", "feature").agg(F.percentile("value", 0.5).alias("median"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def onset_ordinal(df: DataFrame, activity: Column, label: str = "is_malicious") -> DataFrame:
    """(user_id, onset, ordinal): the place of a user's first malicious day among the active days up to it."""
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__a", F.sum(activity.cast("int")).over(w))
    return rows.filter(F.col(label) == 1).groupBy("user_id").agg(F.min("day").alias("onset"), F.min_by("__a", "day").alias("ordinal"))


def temporal_analysis(df: DataFrame, found: DataFrame, activity: Column, label: str = "is_malicious") -> DataFrame:
    """(half_year, early, n_users, n_detected, mean_ordinal, mean_delay) of malicious users by onset; ``early``: not after the median onset.

    ``found`` is what :func:`vigilake.operators.metrics.detection` gives; the median is the onset at half the number of users, rounded down.
    """
    users = onset_ordinal(df, activity, label).join(found.select("user_id", "delay", "detected"), "user_id")
    middle = users.groupBy("onset").agg(F.count(F.lit(1)).alias("c"))  # a row a day
    ranked = middle.withColumn("upto", F.sum("c").over(Window.orderBy("onset").rowsBetween(Window.unboundedPreceding, 0)))
    median = ranked.crossJoin(users.agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))).filter("upto > half").agg(F.min("onset").alias("__median"))  # one row each
    half = F.concat(F.year("onset").cast("string"), F.when(F.month("onset") <= 6, "H1").otherwise("H2"))
    named = users.crossJoin(F.broadcast(median)).withColumns({"half_year": half, "early": F.col("onset") <= F.col("__median")})
    return named.groupBy("half_year", "early").agg(F.count(F.lit(1)).alias("n_users"), F.count_if("detected").alias("n_detected"), F.avg("ordinal").alias("mean_ordinal"), F.avg("delay").alias("mean_delay"))
