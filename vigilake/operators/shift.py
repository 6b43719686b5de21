"""How cohorts differ: effect sizes, distribution distances and stability of every feature in a few passes, whatever their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.operators.drift import unpivot
from vigilake.operators.metrics import ranking_by
from vigilake.operators.ordered import running

#: Probabilities of the five-number summaries and of the bins' edges.
FIVE, TENTHS = (0.0, 0.25, 0.5, 0.75, 1.0), tuple(i / 10 for i in range(11))


def running_by(counts: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """``counts`` (by, value; unique) with ``upto_<name>``, each sum up to and including the row within its group, in one order over all groups."""
    key = F.struct(*by, value)
    held = running(counts.withColumn("__k", key), "__k", {f"upto_{s}": F.col(s) for s in sums})
    base = held.groupBy(*by).agg(*[F.min(F.col(f"upto_{s}") - F.col(s)).alias(f"__b_{s}") for s in sums])
    joined = held.join(base, by)
    return joined.withColumns({f"upto_{s}": F.col(f"upto_{s}") - F.col(f"__b_{s}") for s in sums}).drop("__k", *[f"__b_{s}" for s in sums])


def quantiles_by(counts: DataFrame, by: list[str], value: str, n: str, probabilities: tuple[float, ...], out: str = "quantiles") -> DataFrame:
    """(by, out): interpolated quantiles of each group, exactly, from counts of its distinct values; a task holds no group's values."""
    held = running_by(counts.filter(F.col(n) > 0), by, value, [n])
    total = held.groupBy(*by).agg(F.max(f"upto_{n}").alias("__n"))
    place = F.transform(F.array(*[F.lit(p) for p in probabilities]), lambda p: p * (F.col("__n") - 1))
    wanted = total.withColumn("__place", place)
    low, high = F.col(f"upto_{n}") - F.col(n), F.col(f"upto_{n}")
    inside = lambda r: (r >= low) & (r < high)  # noqa: E731  ranks from 0 that this value has
    hits = held.join(wanted, by).select(*by, value, F.explode(F.filter(F.transform("__place", lambda p, i: F.struct(i.alias("i"), p.alias("p"), inside(F.floor(p)).alias("a"), inside(F.ceil(p)).alias("b"))), lambda x: x["a"] | x["b"])).alias("x"))
    ends = hits.groupBy(*by, "x.i", "x.p").agg(F.max(F.when(F.col("x.a"), F.col(value))).alias("lo"), F.max(F.when(F.col("x.b"), F.col(value))).alias("hi"))
    got = ends.select(*by, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("p") - F.floor("p"))).alias("q"))
    return got.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias(out))


def user_medians(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep, feature, value): each user's median of each feature over its days."""
    long = unpivot(df, ["user_id", *keep], features).filter("value is not null")
    return long.groupBy("user_id", *keep, "feature").agg(F.percentile("value", 0.5).alias("value"))


def scaled(counts: list[str]) -> Column:
    """log1p of the values of counts, others as they are, from (feature, value)."""
    return F.when(F.col("feature").isin(counts), F.log1p("value")).otherwise(F.col("value"))


def cohort_moments(values: DataFrame, cohorts: list[str]) -> DataFrame:
    """(feature, and for each cohort n_, mean_, var_, zero_share_) in one aggregate over (feature, cohort, value, raw)."""
    own = lambda c, x: F.when(F.col("cohort") == c, x)
    aggs = [f(own(c, x)).alias(f"{name}_{c}") for c in cohorts for name, f, x in (("n", F.count, F.col("value")), ("mean", F.avg, F.col("value")), ("var", F.var_samp, F.col("value")), ("zero_share", F.avg, (F.col("raw") == 0).cast("int")))]
    return values.groupBy("feature").agg(*aggs)


def effect(a: str, b: str) -> Column:
    """Cohen's d of cohort ``a`` against ``b`` from :func:`cohort_moments`; null with under two rows or no spread."""
    n, m, v = ([F.col(f"{x}_{c}") for c in (a, b)] for x in ("n", "mean", "var"))
    pooled = ((n[0] - 1) * v[0] + (n[1] - 1) * v[1]) / (n[0] + n[1] - 2)
    fits = (n[0] >= 2) & (n[1] >= 2) & (v[0] + v[1] > 0)
    return F.when(fits, (m[0] - m[1]) / F.sqrt(F.when(fits, pooled)))


def distances(values: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(feature, ks_<a>_<b>): the largest gap between two cohorts' distribution functions, for all pairs in one running sum."""
    names = sorted({c for p in pairs for c in p})
    counts = values.groupBy("feature", "value").agg(*[F.count_if(F.col("cohort") == c).alias(c) for c in names])
    upto = running_by(counts, ["feature"], "value", names)
    n = counts.groupBy("feature").agg(*[F.sum(c).alias(f"n_{c}") for c in names])
    gap = lambda a, b: F.max(F.abs(F.col(f"upto_{a}") / F.col(f"n_{a}") - F.col(f"upto_{b}") / F.col(f"n_{b}"))).alias(f"ks_{a}_{b}")
    return upto.join(n, "feature").groupBy("feature").agg(*[gap(a, b) for a, b in pairs])


def stability(rows: DataFrame, reference: str, cohorts: list[str], floor: float = 1e-6) -> DataFrame:
    """(feature, psi_<cohort>) over (feature, cohort, value): population stability index on the reference's tenths; values outside its range stay in the denominators only."""
    counts = rows.groupBy("feature", "value").agg(*[F.count_if(F.col("cohort") == c).alias(c) for c in [reference, *cohorts]])
    edges = quantiles_by(counts.select("feature", "value", F.col(reference).alias("n")), ["feature"], "value", "n", TENTHS, "edges").withColumn("edges", F.array_distinct("edges"))
    v, bins = F.col("value"), F.greatest(F.size("edges") - 1, F.lit(1))
    inside = (v >= F.element_at("edges", 1)) & (v <= F.element_at("edges", -1))
    placed = counts.join(edges, "feature").withColumn("bin", F.when(inside, F.least(F.size(F.filter("edges", lambda e: e <= v)), bins)).otherwise(F.lit(0))).withColumn("bins", bins)
    per = placed.groupBy("feature", "bins", "bin").agg(*[F.sum(c).alias(c) for c in [reference, *cohorts]])
    total = per.groupBy("feature", "bins").agg(*[F.sum(c).alias(f"__n_{c}") for c in [reference, *cohorts]])
    every = total.withColumn("bin", F.explode(F.sequence(F.lit(1), F.col("bins"))))
    share = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.col(f"__n_{c}"), F.lit(floor))
    term = lambda c: (share(c) - share(reference)) * F.log(share(c) / share(reference))
    return every.join(per, ["feature", "bins", "bin"], "left").groupBy("feature").agg(*[F.sum(term(c)).alias(f"psi_{c}") for c in cohorts])


def feature_shift(df: DataFrame, features: list[str], counts: list[str], cohort: str = "split") -> DataFrame:
    """One row a feature: cohorts' means, spread, zero shares, d and KS of users' medians, PSI of the rows, the mean of these and its rank (1: largest drift).

    Cohorts are train, calibration and test; features named in ``counts`` go through log1p.
    """
    named = df.withColumnRenamed(cohort, "cohort")
    medians = user_medians(named, features, ["cohort"])
    values = medians.select("feature", "cohort", scaled(counts).alias("value"), F.col("value").alias("raw"))
    moments = cohort_moments(values, ["train", "calibration", "test"])
    gaps = distances(values, [("train", "test"), ("calibration", "test")])
    psi = stability(unpivot(named, ["cohort"], features).filter("value is not null"), "train", ["calibration", "test"])
    whole = moments.join(gaps, "feature").join(psi, "feature")
    whole = whole.withColumns({"d_train_test": effect("train", "test"), "d_calibration_test": effect("calibration", "test"), "zero_shift": F.col("zero_share_test") - F.col("zero_share_train")})
    parts = F.array_compact(F.array(F.abs("d_train_test"), F.abs("ks_train_test"), F.col("psi_calibration"), F.col("psi_test")))
    drift = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    from pyspark.sql import Window

    return whole.withColumn("drift", drift).withColumn("drift_rank", F.row_number().over(Window.orderBy(F.desc("drift"), "feature")))  # a row a feature


def graph_diagnosis(df: DataFrame, features: list[str], counts: list[str], cohort: str = "split", label: str = "is_malicious") -> DataFrame:
    """One row a feature: zero and one shares of rows in each cohort, d and KS between training and test rows, and its ROC-AUC alone in both.

    The AUC is of the value as a score, or of its negative for a consistency (a feature not in ``counts``).
    """
    rows = unpivot(df.withColumnRenamed(cohort, "cohort").withColumnRenamed(label, "y"), ["cohort", "y"], features).filter("value is not null")
    own = lambda c, x: F.avg(F.when(F.col("cohort") == c, (F.col("value") == x).cast("int")))
    shares = rows.groupBy("feature").agg(*[own(c, float(x)).alias(f"{n}_share_{c}") for c in ("train", "calibration", "test") for n, x in (("zero", 0), ("one", 1))])
    values = rows.select("feature", "cohort", scaled(counts).alias("value"), F.col("value").alias("raw"))
    moments = cohort_moments(values, ["train", "test"]).select("feature", effect("train", "test").alias("d_train_test"))
    signed = F.when(F.col("feature").isin(counts), F.col("value")).otherwise(-F.col("value"))
    auc = ranking_by(rows.filter("cohort in ('train', 'test')").select("feature", "cohort", signed.alias("score"), "y"), ["feature", "cohort"])
    wide = auc.groupBy("feature").agg(*[F.max(F.when(F.col("cohort") == c, F.col("roc_auc"))).alias(f"auc_{c}") for c in ("train", "test")])
    return shares.join(moments, "feature").join(distances(values, [("train", "test")]), "feature").join(wide, "feature")


def consistency_stability(df: DataFrame, features: list[str], active: Column) -> DataFrame:
    """(feature, n_users, r): correlation, over users, of a feature's deviation with the user's active days."""
    users = df.groupBy("user_id").agg(F.count_if(active).cast("double").alias("__days"), *[F.stddev_samp(f).alias(f) for f in features])
    long = users.unpivot(["user_id", "__days"], features, "feature", "value").filter("value is not null")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n_users"), F.corr("value", "__days").alias("r"))


def threshold_profile(df: DataFrame, t: float, by: str = "split", score: str = "score", label: str = "is_malicious", probabilities: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Of each cohort: score quantiles, the share of scores below the threshold, and the median margin of missed and of alerted malicious rows."""
    y, s = F.col(label) == 1, F.col(score)
    counts = df.groupBy(by, s.cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(y & (s < t)).alias("missed"), F.count_if(y & (s >= t)).alias("caught"))
    grid = quantiles_by(counts, [by], "value", "n", probabilities)
    own = lambda n: quantiles_by(counts, [by], "value", n, (0.5,), "m").select(by, (F.col("m")[0] - t).alias(f"{n}_margin"))
    rows = counts.groupBy(by).agg((F.sum(F.when(F.col("value") < t, F.col("n")).otherwise(0)) / F.sum("n")).alias("percentile_of_threshold"), F.sum("missed").alias("n_missed"), F.sum("caught").alias("n_caught"))
    return rows.join(grid, by).join(own("missed"), by, "left").join(own("caught"), by, "left")
