"""Explanations and the decision table, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.scalar import ALERT_AT, BORDERLINE_WIDTH, MONITOR_AT, recommended_action, risk_level
from vigilake.operators.calibration import confidence, conformal_p, set_category
from vigilake.operators.drift import unpivot

GRAPH = ["device_consistency_score", "rare_device_usage_count", "file_type_consistency_score", "rare_file_type_access_count"]


def linear_contributions(df: DataFrame, weights: dict[str, float], means: dict[str, float]) -> DataFrame:
    """``contribution_<feature>`` = weight * (value - mean) of a linear margin, and the margin."""
    cols = {f"contribution_{f}": F.lit(w) * (F.col(f) - F.lit(means[f])) for f, w in weights.items()}
    return df.withColumns(cols).withColumn("margin", sum((F.lit(w) * F.col(f) for f, w in weights.items()), F.lit(0.0)))


def reconstruction(df: DataFrame, features: list[str], bias: float | Column, margin: str = "margin") -> DataFrame:
    """One row: the largest gap between margin and bias plus contributions."""
    total = sum((F.col(f"contribution_{f}") for f in features), bias if isinstance(bias, Column) else F.lit(bias))
    return df.agg(F.max(F.abs(F.col(margin) - total)).alias("max_gap"))


def _ordered(features: list[str], value, weight) -> Column:
    rows = F.array(*[F.struct((-F.abs(weight(f))).alias("o"), F.lit(i).alias("i"), F.lit(f).alias("feature"), value(f).alias("value"), weight(f).alias("contribution")) for i, f in enumerate(features)])
    return F.array_sort(rows)


def ranked_contributions(features: list[str]) -> Column:
    """Array of (feature, value, contribution, direction, rank), by falling size; ties in the features' order."""
    rows = _ordered(features, lambda f: F.col(f).cast("double"), lambda f: F.col(f"contribution_{f}").cast("double"))
    return F.transform(rows, lambda r, i: F.struct(r["feature"].alias("feature"), F.round(r["value"], 6).alias("value"), F.round(r["contribution"], 6).alias("contribution"), F.when(r["contribution"] > 0, "increased").otherwise("decreased").alias("direction"), (i + 1).alias("rank")))


def top_reasons(features: list[str], n: int = 3, contributions: bool = True) -> Column:
    """The ``n`` largest contributions; without contributions the largest values."""
    if contributions:
        return F.slice(ranked_contributions(features), 1, n)
    rows = _ordered(features, lambda f: F.col(f).cast("double"), lambda f: F.col(f).cast("double"))
    none = F.lit(None)
    return F.slice(F.transform(rows, lambda r, i: F.struct(r["feature"].alias("feature"), F.round(r["value"], 6).alias("value"), none.cast("double").alias("contribution"), none.cast("string").alias("direction"), (i + 1).alias("rank"))), 1, n)


def sentence(r: Column, n_features: int) -> Column:
    """A reason as text."""
    value = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", r["value"]), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(r["feature"], F.lit(" = "), value, F.lit(" "), r["direction"], F.lit(" the risk ("), F.format_string("%+.4f", r["contribution"]), F.lit(", rank "), r["rank"].cast("string"), F.lit(f" of {n_features})"))


def trust_flags() -> Column:
    """Array of the flags that a row raises."""
    new_devices, new_types = F.col("rare_device_usage_count"), F.col("rare_file_type_access_count")
    flags = F.array(
        F.when(new_devices > 0, F.concat(F.lit("new_device_count="), new_devices.cast("int").cast("string"))), F.when(new_types > 0, F.concat(F.lit("new_file_type_count="), new_types.cast("int").cast("string"))),
        F.when(F.col("device_consistency_score") < 0.5, F.lit("low_device_consistency")), F.when(F.col("file_type_consistency_score") < 0.5, F.lit("low_file_type_consistency")),
    )
    return F.filter(flags, lambda f: f.isNotNull())


def graph_values() -> Column:
    return F.create_map(*[x for f in GRAPH for x in (F.lit(f), F.col(f).cast("double"))])


def decision_table(df: DataFrame, calibration: DataFrame, features: list[str], alpha: float = 0.05, score: str = "score", contributions: bool = False, alert: float = ALERT_AT, width: float = BORDERLINE_WIDTH, monitor: float = MONITOR_AT) -> DataFrame:
    """The analyst's row of each user-day: level, conformal set, flags, reasons and action; the label takes no part."""
    held = conformal_p(calibration, df, score).withColumn("risk_level", risk_level(F.col(score), alert, width, monitor)).withColumn("trust_flags", trust_flags())
    held = held.withColumn("n_trust_flags", F.size("trust_flags")).withColumn("conformal_set", set_category(F.col("p1"), F.col("p0"), alpha))
    action = recommended_action(F.col("risk_level"), F.col("n_trust_flags"), F.col(score), alert, width, monitor)
    return held.withColumn("__a", action).select(
        "user_id", "day", F.round(score, 6).alias("ml_risk"), "risk_level", F.round(confidence(F.col("conformal_set"), alpha), 4).alias("confidence"), "conformal_set", F.round("p1", 6).alias("p1"), F.round("p0", 6).alias("p0"),
        F.col("risk_level").isin("ALERT", "BORDERLINE").alias("alert_flag"), F.col("__a.action").alias("recommended_action"), "__a.urgency", "__a.rationale", "trust_flags", "n_trust_flags", graph_values().alias("graph_features"), top_reasons(features, 3, contributions).alias("top_reasons"),
    )


def level_counts(df: DataFrame, level: str = "risk_level") -> DataFrame:
    return df.groupBy(F.upper(level).alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


def explanation_selection(df: DataFrame, t0: float = MONITOR_AT, alert: float = ALERT_AT, width: float = BORDERLINE_WIDTH, per_decile: int = 50, score: str = "score") -> DataFrame:
    """(user_id, day, score, category): alerts, borderline and monitored rows, and of the rest the first ``per_decile`` rows of each decile in (day, user) order."""
    s = F.col(score)
    named = df.withColumn("category", F.when(s >= alert, "alert").when(s >= alert - width, "borderline").when(s >= t0, "monitor").otherwise("sample"))
    rest = named.filter("category = 'sample'")
    edges = rest.agg(F.percentile(score, F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("edges"))
    cut = rest.crossJoin(F.broadcast(edges)).withColumn("decile", F.size(F.filter("edges", lambda e: e < s)))  # one row
    first = cut.withColumn("n", F.row_number().over(Window.partitionBy("decile").orderBy("day", "user_id"))).filter(F.col("n") <= per_decile)
    cols = ["user_id", "day", score, "category"]
    return named.filter("category <> 'sample'").select(*cols).unionByName(first.select(*cols))


def global_importance(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean_abs, median_abs, share, positive_share, top1) over rows with contributions."""
    long = unpivot(df.select("user_id", "day", *[F.col(f"contribution_{f}").alias(f) for f in features]), ["user_id", "day"], features)
    top = df.select(ranked_contributions(features)[0]["feature"].alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("top1"))
    per = long.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.percentile(F.abs("value"), 0.5).alias("median_abs"), F.avg((F.col("value") > 0).cast("int")).alias("positive_share"))
    total = per.agg(F.sum("mean_abs").alias("__t"))
    return per.crossJoin(F.broadcast(total)).join(top, "feature", "left").select("feature", "mean_abs", "median_abs", (F.col("mean_abs") / F.greatest("__t", F.lit(1e-12))).alias("share"), "positive_share", F.coalesce("top1", F.lit(0)).alias("top1"))


def perturbation(df: DataFrame, weights: dict[str, float], deltas: dict[str, float], t: float, score) -> DataFrame:
    """(feature, mean_delta, n_flips): each feature moved by its delta and rescored by ``score`` (a function of a column per feature)."""
    base = score({f: F.col(f) for f in weights})
    moved = [F.struct(F.lit(f).alias("feature"), score({g: F.col(g) + (deltas[f] if g == f else 0.0) for g in weights}).alias("new")) for f in weights]
    rows = df.withColumn("__base", base).select("__base", F.explode(F.array(*moved)).alias("m"))
    return rows.groupBy(F.col("m.feature").alias("feature")).agg(F.avg(F.col("m.new") - F.col("__base")).alias("mean_delta"), F.count_if((F.col("m.new") >= t) != (F.col("__base") >= t)).alias("n_flips"))
