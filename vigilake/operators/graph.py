"""First use, past sets, consistency and department history: what a user did before the day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.scalar import content_type, jaccard

KEY = ["user_id", "day"]


def first_use(rows: DataFrame, by: str, entity: str) -> DataFrame:
    """(by, entity, first_day)."""
    return rows.filter(F.col("day").isNotNull() & F.col(entity).isNotNull() & F.col(by).isNotNull()).groupBy(by, entity).agg(F.min("day").alias("first_day"))


def past_set_size(first: DataFrame, by: str, days: DataFrame) -> DataFrame:
    """``days`` (by, day; unique) with the number of entities whose first day is earlier."""
    new = first.groupBy(by, F.col("first_day").alias("day")).agg(F.count(F.lit(1)).alias("new"))
    marks = days.select(by, "day", F.lit(0).cast("long").alias("new"), F.lit(1).alias("asked")).unionByName(new.select(by, "day", "new", F.lit(0).alias("asked")))
    marks = marks.groupBy(by, "day").agg(F.sum("new").alias("new"), F.max("asked").alias("asked"))
    before = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return marks.withColumn("n_past", F.coalesce(F.sum("new").over(before), F.lit(0))).filter("asked = 1").select(by, "day", "n_past")


def consistency(rows: DataFrame, entity: str, score: str, rare_entities: str | None = None, rare_rows: str | None = None) -> DataFrame:
    """Of each active user-day: Jaccard similarity of the day's entities and the past ones; new entities, or rows of new entities."""
    used = rows.filter("day is not null").groupBy(*KEY, entity).agg(F.count(F.lit(1)).alias("n"))
    # the first day of each entity and what was new before need one partitioning, by user
    own = Window.partitionBy("user_id", entity)
    known = used.withColumn("first_day", F.min("day").over(own))
    per_day = known.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_day"), F.count_if(F.col("first_day") < F.col("day")).alias("n_both"),
        F.count_if(F.col("first_day") >= F.col("day")).alias("n_new"), F.sum(F.when(F.col("first_day") >= F.col("day"), F.col("n")).otherwise(0)).alias("n_new_rows"),
    )
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    past = per_day.withColumn("n_past", F.coalesce(F.sum("n_new").over(before), F.lit(0)))
    out = [jaccard(F.col("n_day"), F.col("n_past"), F.col("n_both")).alias(score)]
    if rare_entities:
        out.append(F.col("n_new").cast("int").alias(rare_entities))
    if rare_rows:
        out.append(F.col("n_new_rows").cast("int").alias(rare_rows))
    return past.select(*KEY, *out)


def department_of_day(rows: DataFrame, snapshots: DataFrame, asof: bool = False) -> DataFrame:
    """``rows`` with the department in last month's snapshot, or with ``asof`` in the latest one of an earlier month; null without."""
    month = F.trunc("day", "MM")
    if not asof:
        own = snapshots.select("user_id", F.add_months("snapshot_month", 1).alias("__month"), "department")
        return rows.withColumn("__month", month).join(own, ["user_id", "__month"], "left").drop("__month")
    until = F.lead("snapshot_month").over(Window.partitionBy("user_id").orderBy("snapshot_month"))
    own = snapshots.withColumn("__until", until).select(F.col("user_id").alias("__user"), "snapshot_month", "__until", "department")
    valid = (F.col("user_id") == F.col("__user")) & (F.col("snapshot_month") < month) & (F.col("__until").isNull() | (F.col("__until") >= month))
    return rows.join(own, valid, "left").drop("__user", "__until", "snapshot_month")


def department_mismatch(file_rows: DataFrame, snapshots: DataFrame, asof: bool = False) -> DataFrame:
    """File rows whose type was first used on or after the day by the department the user had that day."""
    placed = department_of_day(file_rows.filter("day is not null"), snapshots, asof).filter("department is not null")
    used = placed.groupBy(*KEY, "department", "type").agg(F.count(F.lit(1)).alias("n"))
    first = used.groupBy("department", "type").agg(F.min("day").alias("first_day"))
    return used.join(first, ["department", "type"]).groupBy(*KEY).agg(F.sum(F.when(F.col("first_day") >= F.col("day"), F.col("n")).otherwise(0)).cast("int").alias("department_file_type_mismatch_count"))


def graph_features(logon: DataFrame, file: DataFrame, snapshots: DataFrame, grid: DataFrame, asof: bool = False) -> DataFrame:
    """The grid with device and file-type consistency, rare counts and department mismatches; 0 on days without activity."""
    typed = file.withColumn("type", content_type(F.col("content")))
    device = consistency(logon.filter("activity = 'Logon'"), "pc", "device_consistency_score", rare_entities="rare_device_usage_count")
    kinds = consistency(typed, "type", "file_type_consistency_score", rare_rows="rare_file_type_access_count")
    other = department_mismatch(typed, snapshots, asof)
    joined = grid.join(device, KEY, "left").join(kinds, KEY, "left").join(other, KEY, "left")
    names = ["device_consistency_score", "rare_device_usage_count", "file_type_consistency_score", "rare_file_type_access_count", "department_file_type_mismatch_count"]
    return joined.select(*grid.columns, *[F.coalesce(c, F.lit(0.0 if c.endswith("score") else 0)).alias(c) for c in names])
