"""Alert masks, time windows, suppression, and the rules that choose among policies."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.scalar import ALERT_AT
from vigilake.operators.metrics import best_f1, binary_metrics, gini
from vigilake.sources.scratch import written

#: The candidate policies.
CAPACITIES, PERCENTILES = [5, 10, 20, 30, 50, 100], [0.0005, 0.001, 0.0025, 0.005, 0.01]


def threshold_mask(df: DataFrame, t: float, score: str = "score") -> DataFrame:
    return df.withColumn("alert", F.col(score) >= F.lit(t))


def daily_top_k(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """``alert`` on the k highest scores of each day; ties go to the smaller user."""
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc(score), "user_id"))
    return df.withColumn("alert", rank <= k)


def top_share(df: DataFrame, p: float, score: str = "score") -> DataFrame:
    """``alert`` on the ceil(p * rows) highest scores; ties go to the smaller user and day.

    The cutoff score comes from running counts of the distinct scores; only rows
    tied at it are ranked, so no task holds all rows.
    """
    from vigilake.operators.ordered import running

    counts = df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    n = df.agg(F.ceil(F.count(F.lit(1)) * F.lit(p)).alias("__k"))
    ranked = running(counts, "s", {"upto": F.col("c")}, descending=True).crossJoin(F.broadcast(n))  # one row
    cut = ranked.filter(F.col("upto") - F.col("c") < F.col("__k")).agg(F.min("s").alias("__cut"), F.max(F.struct("upto", "c")).alias("__last"), F.first("__k").alias("__k"))
    held = df.crossJoin(F.broadcast(cut))  # one row
    place = F.row_number().over(Window.partitionBy(F.when(F.col(score) == F.col("__cut"), 0).otherwise(F.pmod(F.xxhash64("user_id", "day"), F.lit(1 << 20)) + 1)).orderBy("user_id", "day"))
    left = F.col("__k") - (F.col("__last.upto") - F.col("__last.c"))
    alert = (F.col(score) > F.col("__cut")) | ((F.col(score) == F.col("__cut")) & (place <= left))
    return held.withColumn("alert", F.coalesce(alert, F.lit(False))).drop("__cut", "__last", "__k")


def policy(df: DataFrame, kind: str, param: float, score: str = "score") -> DataFrame:
    if kind == "threshold":
        return threshold_mask(df, param, score)
    if kind == "capacity":
        return daily_top_k(df, int(param), score)
    if kind == "percentile":
        return top_share(df, param, score)
    raise ValueError(f"unknown policy kind: {kind}")


def candidates(t_frozen: float = ALERT_AT, t_p50: float | None = None) -> dict[str, tuple[str, float]]:
    found = {"T_FROZEN": ("threshold", t_frozen)} | ({"T_P50": ("threshold", t_p50)} if t_p50 is not None else {})
    return found | {f"CAP_{k}": ("capacity", k) for k in CAPACITIES} | {f"PCT_{p}": ("percentile", p) for p in PERCENTILES}


def masks(df: DataFrame, policies: Mapping[str, tuple[str, float]], score: str = "score") -> DataFrame:
    """``df`` with ``candidates``, an array of (candidate, kind, alert): all policies as columns of one frame.

    The capacities share one rank a day, and the percentiles one cut each from
    the running counts of the distinct scores; only rows tied at a cut are ranked.
    """
    from vigilake.operators.ordered import running

    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc(score), "user_id"))
    held = df.withColumn("__day_rank", rank) if any(k == "capacity" for k, _ in policies.values()) else df
    shares = sorted({p for k, p in policies.values() if k == "percentile"})
    if shares:
        counts = df.groupBy(F.col(score).alias("__s")).agg(F.count(F.lit(1)).alias("__c"))
        upto = running(counts, "__s", {"__upto": F.col("__c")}, descending=True).select("__s", (F.col("__upto") - F.col("__c")).alias("__before"))
        n = df.agg(F.count(F.lit(1)).alias("__n"))
        held = held.join(upto, F.col(score) == F.col("__s")).crossJoin(F.broadcast(n))  # one row
        cut = reduce(lambda a, b: a | b, [(F.col("__before") < F.ceil(F.col("__n") * F.lit(p))) & (F.col("__before") + F.col("__ties") > F.ceil(F.col("__n") * F.lit(p))) for p in shares])
        held = held.withColumn("__ties", F.count(F.lit(1)).over(Window.partitionBy(score)))
        tied = F.row_number().over(Window.partitionBy(F.when(cut, F.col(score)), F.when(~cut, F.struct("user_id", "day"))).orderBy("user_id", "day"))
        held = held.withColumn("__rank", F.col("__before") + F.when(cut, tied).otherwise(F.lit(1)))
    alert = {"threshold": lambda p: F.col(score) >= F.lit(p), "capacity": lambda p: F.col("__day_rank") <= int(p), "percentile": lambda p: F.col("__rank") <= F.ceil(F.col("__n") * F.lit(p))}
    each = [F.struct(F.lit(name).alias("candidate"), F.lit(kind).alias("kind"), alert[kind](param).alias("alert")) for name, (kind, param) in policies.items()]
    return held.select(*[F.col(f"`{c}`") for c in df.columns], F.array(*each).alias("candidates"))


def by_candidate(df: DataFrame, policies: Mapping[str, tuple[str, float]], label: str = "is_malicious", by: list[str] | None = None) -> DataFrame:
    """(candidate, kind, by, alert, label, n): rows counted before they are multiplied by the candidates' number."""
    held = masks(df, policies).withColumnRenamed(label, "__y")
    few = held.groupBy(*(by or []), "__y", "candidates").agg(F.count(F.lit(1)).alias("__w"))
    return few.select(*(by or []), F.col("__y").alias(label), "__w", F.explode("candidates").alias("x")).select(*(by or []), label, "__w", "x.candidate", "x.kind", "x.alert")


def evaluate(df: DataFrame, policies: Mapping[str, tuple[str, float]], label: str = "is_malicious", by: list[str] | None = None) -> DataFrame:
    """The metrics of each policy, by ``candidate`` and ``kind`` (and ``by``), in one pass over ``df``."""
    return binary_metrics(by_candidate(df, policies, label, by), F.col("alert"), F.col(label), ["candidate", "kind", *(by or [])], weight="__w")


def day_windows(df: DataFrame, n: int | None = None, days: int | None = None) -> DataFrame:
    """``df`` with ``window``: ``n`` near-equal blocks of its distinct days (larger ones first), or blocks of ``days`` days with a short tail; numbered from 0."""
    order = Window.orderBy("day")
    block = F.ntile(n).over(order) - 1 if n else F.floor((F.row_number().over(order) - 1) / days)
    blocks = df.select("day").distinct().withColumn("window", block.cast("int"))  # distinct days only
    return df.join(F.broadcast(blocks), "day")


def window_bounds(df: DataFrame) -> DataFrame:
    return df.groupBy("window").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("day").alias("n_days"), F.count(F.lit(1)).alias("n_rows"))


def calendar_windows(day: Column, start, width: int = 7) -> Column:
    """Number of the fixed window of ``width`` days since ``start``."""
    return F.floor(F.datediff(day, F.lit(start).cast("date")) / width).cast("int")


def window_policy_metrics(df: DataFrame, label: str = "is_malicious", score: str = "score") -> DataFrame:
    """Of each window of a frame with ``window`` and ``alert``: metrics and the score's distribution."""
    stats = df.groupBy("window").agg(F.min(score).alias("score_min"), F.max(score).alias("score_max"), *[F.percentile(score, q).alias(n) for n, q in (("score_p50", 0.5), ("score_p90", 0.9), ("score_p99", 0.99))])
    return binary_metrics(df, F.col("alert"), F.col(label), ["window"]).join(stats, "window")


def suppress(df: DataFrame, days: int, mask: str = "alert") -> DataFrame:
    """``emitted``: an alert stays if the user's last one that stayed is at least ``days`` days back.

    What stays depends on what stayed before, so each user's alert days are
    folded in order; a user has at most one entry a day.
    """
    alerts = df.filter(F.col(mask)).groupBy("user_id").agg(F.sort_array(F.collect_set("day")).alias("days"))
    start = F.array().cast("array<date>")
    step = lambda acc, d: F.when((F.size(acc) == 0) | (F.datediff(d, F.try_element_at(acc, F.lit(-1))) >= days), F.concat(acc, F.array(d))).otherwise(acc)
    stays = alerts.select("user_id", F.explode(F.aggregate("days", start, step)).alias("day")).withColumn("__stays", F.lit(True))
    return df.join(stays, ["user_id", "day"], "left").withColumn("emitted", F.col(mask) & F.coalesce("__stays", F.lit(False))).drop("__stays")


def zero_alert_chunks(df: DataFrame, days: int = 7, mask: str = "alert") -> DataFrame:
    """(n_chunks, n_zero): blocks of ``days`` days, and those without an alert."""
    blocks = day_windows(df, days=days).groupBy("window").agg(F.count_if(F.col(mask)).alias("n"))
    return blocks.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("n") == 0).alias("n_zero"))


def user_concentration(df: DataFrame, mask: str = "alert") -> DataFrame:
    """How alerts spread over the users that have any: mean, median, most, shares of the top 1, 5 and 10 % and Gini."""
    counts = df.filter(F.col(mask)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    shape = counts.agg(F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("n_alerts"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"))
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("users"))  # as many rows as there are different counts
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    placed = by_count.withColumn("before", F.coalesce(F.sum("users").over(upto), F.lit(0))).crossJoin(F.broadcast(shape.select(F.col("n_users").alias("__users"), F.col("n_alerts").alias("__alerts"))))
    share = lambda q: (F.sum(F.col("n") * F.greatest(F.lit(0), F.least(F.col("users"), F.ceil(F.col("__users") * q) - F.col("before")))) / F.greatest(F.first("__alerts"), F.lit(1))).alias(f"top_{round(q * 100)}pct_share")
    return shape.crossJoin(placed.agg(*[share(q) for q in (0.01, 0.05, 0.10)])).crossJoin(gini(counts, "n"))


def policy_metrics(df: DataFrame, label: str = "is_malicious", mask: str = "alert", days: int = 7) -> DataFrame:
    """One row: metrics, alerts by user over all users, Gini, weeks without an alert."""
    users = df.groupBy("user_id").agg(F.count_if(F.col(mask)).alias("n"))
    spread = users.agg(F.count_if(F.col("n") > 0).alias("n_users_alerted"), F.max("n").alias("most_by_user"), F.avg("n").alias("mean_by_user"), (F.sum("n") / F.greatest(F.count_if(F.col("n") > 0), F.lit(1))).alias("mean_by_alerted"))
    return binary_metrics(df, F.col(mask), F.col(label)).crossJoin(spread).crossJoin(gini(users, "n")).crossJoin(zero_alert_chunks(df, days, mask).select("n_zero"))


def rolling_thresholds(df: DataFrame, days: int, frozen: float = ALERT_AT, label: str = "is_malicious", score: str = "score") -> DataFrame:
    """(window, threshold): each window's best-F1 threshold over all earlier windows; ``frozen`` where those have no positive.

    Earlier windows are met by distinct score, not by row.
    """
    counts = day_windows(df, days=days).groupBy("window", F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    windows = counts.select(F.col("window").alias("at")).distinct()
    past = windows.join(counts, F.col("window") < F.col("at")).groupBy("at", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    past = written(past, "past")
    fitted = best_f1(past, by=["at"]).select(F.col("at").alias("window"), F.when(F.col("f1") > 0, F.col("threshold")).alias("threshold"))
    return windows.select(F.col("at").alias("window")).join(fitted, "window", "left").select("window", F.coalesce("threshold", F.lit(frozen)).alias("threshold"))


def apply_rolling(df: DataFrame, thresholds: DataFrame, days: int, score: str = "score") -> DataFrame:
    return day_windows(df, days=days).join(F.broadcast(thresholds), "window").withColumn("alert", F.col(score) >= F.col("threshold"))


def screens(overall: DataFrame, by_window: DataFrame, widths: DataFrame | None = None, most_width: float = 0.2, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Screens of each candidate: S1 interval width (thresholds only), S2 window alert rates near the whole's, S3 no window without recall."""
    rates = by_window.join(overall.select("candidate", F.col("alert_rate").alias("whole")), "candidate")
    bad = rates.groupBy("candidate").agg(F.count_if((F.col("alert_rate") < low * F.col("whole")) | (F.col("alert_rate") > high * F.col("whole"))).alias("bad_windows"), F.count_if(F.col("recall") == 0).alias("zero_windows"))
    found = overall.join(bad, "candidate")
    wide = F.lit(False)
    if widths is not None:
        found = found.join(widths.select("candidate", "ci_width"), "candidate", "left")
        wide = F.coalesce((F.col("kind") == "threshold") & (F.col("ci_width") > most_width), F.lit(False))
    found = found.withColumn("s1", ~wide).withColumn("s2", (F.col("alert_rate") > 0) & (F.col("bad_windows") == 0)).withColumn("s3", F.col("zero_windows") == 0)
    return found.withColumn("eligible", F.expr("s1 and s2 and s3"))


def select_policy(screened: DataFrame) -> DataFrame:
    """The eligible candidate with the best F1, then the fewest alerts, then the last name."""
    return screened.filter("eligible").orderBy(F.desc("f1"), "alert_rate", F.desc("candidate")).limit(1)


def select_operational(table: DataFrame, base: str = "P0") -> DataFrame:
    """Rules R1-R4 against the base policy: recall kept to 90 %, alerts cut to 90 %, Gini and silent weeks no worse; the base if none holds."""
    p0 = table.filter(F.col("policy") == base).select(F.col("recall").alias("r0"), F.col("n_alerts").alias("a0"), F.col("gini").alias("g0"), F.col("n_zero").alias("z0"))
    tests = (F.col("recall") >= 0.9 * F.col("r0")) & (F.col("n_alerts") <= 0.9 * F.col("a0")) & (F.col("gini") <= F.col("g0") + 0.05) & (F.col("n_zero") <= F.col("z0"))
    ranked = table.crossJoin(F.broadcast(p0)).withColumn("passes", tests & (F.col("policy") != base))  # one row
    return ranked.filter(F.col("passes") | (F.col("policy") == base)).orderBy(F.desc("passes"), F.desc("recall"), "n_alerts", F.desc("f1"), "policy").limit(1).drop("r0", "a0", "g0", "z0")


def bounds(stats: DataFrame, reference: Mapping[str, float], margin: float = 0.10) -> DataFrame:
    """(window, bound, status) of bounds B1-B6 on window statistics: pass, caution (off by at most the margin) or fail.

    ``reference``: alerts_per_day, score_median, precision.
    """

    def floor(value: Column, least: float) -> Column:
        return F.when(value >= least, "pass").when(value >= least * (1 - margin), "caution").otherwise("fail")

    def band(value: Column, lo: float, hi: float) -> Column:
        return F.when(value.between(lo, hi), "pass").when(value.between(lo * (1 - margin), hi * (1 + margin)), "caution").otherwise("fail")

    positives = F.col("n_positives") > 0
    tests = {
        "B1": F.when(F.col("n_alerts") >= 1, "pass").otherwise("fail"),
        "B2": band(F.col("alerts_per_day"), 0.5 * reference["alerts_per_day"], 2 * reference["alerts_per_day"]),
        "B3": band(F.col("score_median"), 0.5 * reference["score_median"], 2 * reference["score_median"]),
        "B4": F.when(~positives, "pass").otherwise(floor(F.col("recall"), 0.25)),
        "B5": F.when(F.col("n_alerts") == 0, "pass").otherwise(floor(F.col("precision"), 0.5 * reference["precision"])),
        "B6": F.when(positives & (F.col("recall") == 0), "fail").otherwise("pass"),
    }
    rows = F.array(*[F.struct(F.lit(b).alias("bound"), t.alias("status")) for b, t in tests.items()])
    return stats.select("window", F.explode(rows).alias("x")).select("window", "x.bound", "x.status")


def verdict(checks: DataFrame) -> DataFrame:
    """One row: PASS without violation, CAUTION with at most two, all marginal, else FAIL."""
    n, bad = F.count_if(F.col("status") != "pass"), F.count_if(F.col("status") == "fail")
    return checks.agg(n.alias("n_violations"), bad.alias("n_failures"), F.when(n == 0, "PASS").when((n <= 2) & (bad == 0), "CAUTION").otherwise("FAIL").alias("verdict"))


def capacity_projection(df: DataFrame, mask: str = "alert", factors: tuple[float, ...] = (1.0, 2.0, 5.0)) -> DataFrame:
    """Alerts a day now and when the users grow by each factor, the busiest day, and the shares of the busiest user and of the top 1 % of the users with alerts."""
    days = df.groupBy("day").agg(F.countDistinct("user_id").alias("users"), F.count_if(F.col(mask)).alias("alerts"))
    one = days.agg(F.avg("users").alias("users_per_day"), F.avg("alerts").alias("alerts_per_day"), F.max("alerts").alias("most_alerts"))
    shares = user_concentration(df, mask).select((F.col("most") / F.greatest("n_alerts", F.lit(1))).alias("top_user_share"), "top_1pct_share")
    return one.crossJoin(shares).select("*", F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor")).withColumn("projected_alerts_per_day", F.col("alerts_per_day") * F.col("factor"))

