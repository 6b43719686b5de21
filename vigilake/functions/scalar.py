"""Column functions: parsing, bands, intervals and the normal distribution."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content prefixes of sensitive file types (OLE2, PDF, ZIP).
SENSITIVE_PREFIXES = ["D0-CF-11-E0-A1-B1-1A-E1", "25-50-44-46-2D", "50-4B-03-04"]
LOG_FORMAT = "MM/dd/yyyy HH:mm:ss"
ID_PATTERN, USER_PATTERN, PC_PATTERN = r"^\{[A-Z0-9-]+\}$", r"^[A-Z]{3}\d{4}$", r"^PC-\d{4}$"
#: Score bands of the decision table.
ALERT_AT, BORDERLINE_WIDTH, MONITOR_AT = 0.9186015432508062, 0.05, 0.4634739481800199


def parse_ts(text: Column, *formats: str) -> Column:
    """Timestamp by the first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats or (LOG_FORMAT,)])


def content_type(content: Column) -> Column:
    """The sensitive prefix that the content starts with, else ``other``."""
    text = F.coalesce(content, F.lit(""))
    return reduce(lambda rest, p: F.when(text.startswith(p), F.lit(p)).otherwise(rest), reversed(SENSITIVE_PREFIXES), F.lit("other"))


def after_hours(ts: Column, start: int = 8, end: int = 18) -> Column:
    return (F.hour(ts) < start) | (F.hour(ts) >= end)


def activity_bucket(n: Column) -> Column:
    """Band of a count of malicious days."""
    bands = [(1, "1"), (5, "2-5"), (12, "6-12"), (44, "13-44"), (100, "45-100")]
    return reduce(lambda rest, b: F.when(n <= b[0], F.lit(b[1])).otherwise(rest), reversed(bands), F.lit("101+"))


def length_class(n: Column, short: int = 12, long: int = 45) -> Column:
    return F.when(n <= short, "short").when(n >= long, "long").otherwise("middle")


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def drift_scale(value: Column, is_ratio: bool) -> Column:
    """Counts on a log scale, ratios as they are."""
    return value if is_ratio else F.log1p(value)


def clip_z(z: Column, most: float = 3.0) -> Column:
    return F.least(F.abs(z), F.lit(most))


def normal_cdf(x: Column, terms: int = 40) -> Column:
    """Standard normal distribution function, to double precision for abs(x) <= 4: its odd power series as a nested product."""
    square = x * x
    series = reduce(lambda s, k: F.lit(1.0) + square / float(2 * k + 1) * s, range(terms, 0, -1), F.lit(1.0))
    return F.lit(0.5) + F.exp(-square / 2.0) / math.sqrt(2 * math.pi) * x * series


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, with a denominator of at least 1."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


def jaccard(day: Column, past: Column, both: Column) -> Column:
    """Similarity of a day's set and the past set; 0 if either is empty."""
    return F.when((day > 0) & (past > 0), both.cast("double") / (day + past - both)).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.6448536269514722) -> tuple[Column, Column]:
    """Wilson interval, clamped to [0, 1]; null for n = 0."""
    size = F.when(n > 0, n.cast("double"))
    p, zz = k / size, z * z
    mid, wide = (p + zz / (2 * size)) / (1 + zz / size), z * F.sqrt(p * (1 - p) / size + zz / (4 * size * size)) / (1 + zz / size)
    return F.when(n > 0, F.greatest(mid - wide, F.lit(0.0))), F.when(n > 0, F.least(mid + wide, F.lit(1.0)))


def close(a: Column, b: Column, rel: float = 1e-9) -> Column:
    return F.abs(a - b) <= rel * F.greatest(F.lit(1.0), F.abs(b))


def risk_level(score: Column, alert: float = ALERT_AT, width: float = BORDERLINE_WIDTH, monitor: float = MONITOR_AT) -> Column:
    return F.when(score >= alert, "ALERT").when(score >= alert - width, "BORDERLINE").when(score >= monitor, "MONITOR").otherwise("NON-ALERT")


def explained_level(alert: Column, categories: Column) -> Column:
    """Level from an alert flag and the selections of :func:`vigilake.operators.decision.explanation_selection`."""
    return F.when(alert, "ALERT").when(categories == "borderline", "BORDERLINE").when(categories == "monitor", "MONITOR").otherwise("NON-ALERT")


def recommended_action(level: Column, n_flags: Column, score: Column, alert: float = ALERT_AT, width: float = BORDERLINE_WIDTH, monitor: float = MONITOR_AT) -> Column:
    """Struct of action, urgency and rationale."""
    s, a, b, m = F.format_string("%.4f", F.bround(score, 4)), f"{alert:.4f}", f"{alert - width:.4f}", f"{monitor:.4f}"
    action = F.when(level == "ALERT", "escalate_to_incident_response").when(level == "BORDERLINE", "queue_for_analyst_review").when(level == "MONITOR", "add_to_watchlist").otherwise("no_action_required")
    urgency = F.when(level == "ALERT", "immediate").when(level == "BORDERLINE", "within_24h").when(level == "MONITOR", "weekly").otherwise("none")
    why = (
        F.when(level == "ALERT", F.concat(F.lit("Score "), s, F.lit(f" >= frozen alert threshold {a}")))
        .when(level == "BORDERLINE", F.concat(F.lit("Score "), s, F.lit(f" in borderline zone [{b}, {a})")))
        .when(level == "MONITOR", F.concat(F.lit("Score "), s, F.lit(f" in monitor zone [{m}, {b})")))
        .otherwise(F.concat(F.lit("Score "), s, F.lit(f" < conformal threshold {m}")))
    )
    flags = F.when(n_flags > 0, F.concat(F.lit("; "), n_flags.cast("string"), F.lit(" trust flag(s) active"))).otherwise(F.lit(""))
    return F.struct(action.alias("action"), urgency.alias("urgency"), F.concat(why, flags).alias("rationale"))


def sigmoid(z: Column, most: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-most), F.least(F.lit(most), z))))


def logit(p: Column, edge: float = 1e-6, most: float = 20.0) -> Column:
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.log(q / (1 - q))))
