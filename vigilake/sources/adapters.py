"""Activity logs, incidents, departments and scores as views over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.scalar import SENSITIVE_PREFIXES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return df.select(F.col("event_id").alias("id"), "ts", F.to_date("ts").alias("day"), "user_id", "event_type", k.alias("k"), "value")


def pc(k: str = "k"):
    return F.concat(F.lit("PC-"), F.lpad((F.col(k) % 25).cast("string"), 4, "0"))


def logon(ev: DataFrame) -> DataFrame:
    return ev.withColumn("pc", pc()).withColumn("activity", F.when(F.col("event_type") == "error", "Logoff").otherwise("Logon"))


def device(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event_type").isin("signup", "purchase")).withColumn("activity", F.when(F.col("event_type") == "purchase", "Connect").otherwise("Disconnect"))


def file(ev: DataFrame) -> DataFrame:
    kind = F.col("k") % 10
    content = F.when(kind == 0, SENSITIVE_PREFIXES[0]).when(kind == 1, SENSITIVE_PREFIXES[1]).when(kind == 2, SENSITIVE_PREFIXES[2]).otherwise("FF-D8")
    return ev.filter(F.col("event_type").isin("purchase", "click")).withColumn("content", content)


def http(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event_type").isin("view", "click"))


def users(ev: DataFrame) -> DataFrame:
    return ev.select("user_id").distinct()


def incidents(ev: DataFrame) -> DataFrame:
    """Every fifth user has one incident of four days."""
    start = F.date_add(F.lit("2024-01-05").cast("date"), (F.col("user_id") * 7 % 22).cast("int"))
    return users(ev).filter("user_id % 5 = 2").select("user_id", (F.col("user_id") % 3 + 1).cast("int").alias("scenario"), start.alias("start"), F.date_add(start, 3).alias("end"))


def departments(ev: DataFrame) -> DataFrame:
    """(snapshot_month, user_id, department): two snapshots."""
    one, two = (F.lit(m).cast("date").alias("snapshot_month") for m in ("2023-12-01", "2024-01-01"))
    u = users(ev)
    return u.select(one, "user_id", (F.col("user_id") % 5).alias("department")).unionByName(u.select(two, "user_id", ((F.col("user_id") + 1) % 5).alias("department")))
