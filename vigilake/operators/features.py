"""The dense user-day table: grid, behavioural counts, labels and splits."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.scalar import SENSITIVE_PREFIXES, after_hours

KEY = ["user_id", "day"]
COUNTS = ["login_count", "after_hours_login_count", "usb_connection_count", "file_access_count", "sensitive_file_access_count", "http_activity_count", "unique_device_count", "unusual_access_count"]


def user_day_grid(users: DataFrame, start, end) -> DataFrame:
    """One row for each user and each day from ``start`` to ``end``."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return users.select("user_id").distinct().select("user_id", F.explode(days).alias("day"))


def _dated(df: DataFrame) -> DataFrame:
    return df.filter(F.col("day").isNotNull() & F.col("user_id").isNotNull())


def logon_features(logon: DataFrame, start: int = 8, end: int = 18, devices_of_all: bool = False) -> DataFrame:
    """Logon rows, those out of hours, and distinct PCs (of Logon rows, or with ``devices_of_all`` of all rows)."""
    own = F.col("activity") == "Logon"
    df = _dated(logon) if devices_of_all else _dated(logon).filter(own)
    agg = df.groupBy(*KEY).agg(
        F.count_if(own & F.col("id").isNotNull()).cast("int").alias("login_count"),
        F.count_if(own & after_hours(F.col("ts"), start, end)).cast("int").alias("after_hours_login_count"),
        F.countDistinct("pc").cast("int").alias("unique_device_count"),
    )
    return agg


def device_features(device: DataFrame) -> DataFrame:
    return _dated(device).filter("activity = 'Connect'").groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("usb_connection_count"))


def sensitive(content: Column) -> Column:
    """Whether the content starts with a sensitive prefix; null doesn't."""
    found = F.lit(False)
    for p in SENSITIVE_PREFIXES:
        found = found | F.coalesce(content.startswith(p), F.lit(False))
    return found


def file_features(file: DataFrame) -> DataFrame:
    return _dated(file).groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("file_access_count"), F.count_if(sensitive(F.col("content"))).cast("int").alias("sensitive_file_access_count"))


def http_features(http: DataFrame) -> DataFrame:
    return _dated(http).groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("http_activity_count"))


def unusual_access(logon: DataFrame, window_days: int = 28) -> DataFrame:
    """Logon events on a PC that the user had no Logon on in the ``window_days`` days before.

    The day before on the same PC decides: one window over distinct user-PC-days
    instead of an interval join of the events.
    """
    own = _dated(logon).filter("activity = 'Logon'").groupBy("user_id", "pc", "day").agg(F.count(F.lit(1)).alias("n"))
    last = F.lag("day").over(Window.partitionBy("user_id", "pc").orderBy("day"))
    rows = own.withColumn("last", last).filter(F.col("last").isNull() | (F.datediff("day", "last") > window_days))
    return rows.groupBy(*KEY).agg(F.sum("n").cast("int").alias("unusual_access_count"))


def unusual_access_join(logon: DataFrame, window_days: int = 28) -> DataFrame:
    """The same as an interval anti-join, for comparison."""
    own = _dated(logon).filter("activity = 'Logon'")
    days = own.select("user_id", "pc", F.col("day").alias("before")).distinct()
    near = (F.col("before") < F.col("day")) & (F.col("before") >= F.date_sub("day", window_days))
    on = [own["user_id"] == days["user_id"], own["pc"].eqNullSafe(days["pc"]), near]
    return own.join(days, on, "left_anti").groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("unusual_access_count"))


def user_day_table(logs: Mapping[str, DataFrame], grid: DataFrame, window_days: int = 28) -> DataFrame:
    """The grid with the eight counts, zero where a user did nothing.

    The parts are stacked and added up in one aggregate by user and day, so the
    grid meets them in one shuffle.
    """
    parts = [logon_features(logs["logon"]), device_features(logs["device"]), file_features(logs["file"]), http_features(logs["http"]), unusual_access(logs["logon"], window_days)]
    wide = [p.select(*KEY, *[(F.col(c) if c in p.columns else F.lit(0)).cast("int").alias(c) for c in COUNTS]) for p in parts]
    whole = grid.select(*KEY, *[F.lit(0).cast("int").alias(c) for c in COUNTS], F.lit(1).alias("__grid"))
    for w in wide:
        whole = whole.unionByName(w.withColumn("__grid", F.lit(0)))
    summed = whole.groupBy(*KEY).agg(*[F.sum(c).cast("int").alias(c) for c in COUNTS], F.max("__grid").alias("__grid"))
    return summed.filter("__grid = 1").select(*KEY, *COUNTS)


def label_days(grid: DataFrame, incidents: DataFrame) -> DataFrame:
    """``is_malicious`` of each grid row: 1 from an incident's start to its end; incidents without both dates don't count."""
    days = incidents.filter("start is not null and end is not null and start <= end").select("user_id", F.explode(F.sequence("start", "end")).alias("day")).distinct().withColumn("__hit", F.lit(1))
    return grid.join(days, KEY, "left").select(*grid.columns, F.coalesce("__hit", F.lit(0)).alias("is_malicious"))


def _day(value) -> date:
    """A boundary given as a date, a timestamp or ISO text."""
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else date.fromisoformat(str(value)[:10])


def split_of(day: Column, train_end, calibration_end) -> Column:
    """train, calibration or test, by two inclusive boundaries."""
    if _day(train_end) >= _day(calibration_end):
        raise ValueError("train_end must be before calibration_end")
    return F.when(day <= F.lit(train_end).cast("date"), "train").when(day <= F.lit(calibration_end).cast("date"), "calibration").otherwise("test")


def split_table(df: DataFrame, train_end, calibration_end) -> dict[str, DataFrame]:
    split = df.withColumn("split", split_of(F.col("day"), train_end, calibration_end))
    return {name: split.filter(F.col("split") == name).drop("split") for name in ("train", "calibration", "test")}


def split_summary(df: DataFrame, train_end, calibration_end, label: str = "is_malicious") -> DataFrame:
    """Rows, days, users and malicious rows of each split that has rows; :func:`check_splits` fails where one has none."""
    found = df.withColumn("split", split_of(F.col("day"), train_end, calibration_end)).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("day").alias("n_days"), F.countDistinct("user_id").alias("n_users"),
        F.sum(label).cast("long").alias("n_malicious"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )
    return found


def check_splits(df: DataFrame, train_end, calibration_end) -> None:
    """Fails if a split has no row."""
    found = {r["split"] for r in df.select(split_of(F.col("day"), train_end, calibration_end).alias("split")).distinct().collect()}  # three values at most
    empty = [s for s in ("train", "calibration", "test") if s not in found]
    if empty:
        raise ValueError(f"empty splits: {empty}")


def point_lookup(df: DataFrame, user, day) -> DataFrame:
    """The row of one user-day; both conditions reach the scan."""
    return df.filter((F.col("user_id") == F.lit(user)) & (F.col("day") == F.lit(day).cast("date")))


def align(base: DataFrame, extra: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One row: rows, repeated keys and keys missing on either side."""
    a = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    b = extra.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, keys, "full_outer")
    return both.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_base"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_extra"), F.count_if(F.col("a") > 1).alias("base_repeats"), F.count_if(F.col("b") > 1).alias("extra_repeats"),
        F.count_if(F.col("b").isNull()).alias("missing_in_extra"), F.count_if(F.col("a").isNull()).alias("missing_in_base"),
    )


def verify_alignment(base: DataFrame, extra: DataFrame, keys: list[str] = KEY) -> None:
    found = align(base, extra, keys).first().asDict()
    wrong = {k: v for k, v in found.items() if k[:2] != "n_" and v}
    if wrong:
        raise ValueError(f"keys don't match: {wrong}")


def merge_columns(base: DataFrame, extra: DataFrame, columns: list[str], keys: list[str] = KEY) -> DataFrame:
    """``base`` with columns of ``extra``, one row for one; a key without a match or a null value is an error when the row is made."""
    held = base.join(extra.select(*keys, *columns), keys, "left")
    return held.select(*base.columns, *[F.coalesce(F.col(c), F.raise_error(F.lit(f"no value of {c}")).cast(extra.schema[c].dataType)).alias(c) for c in columns])
