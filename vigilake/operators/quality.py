"""Data-quality checks: each is one row of (file, check, metric, value, ok)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.scalar import ID_PATTERN, PC_PATTERN, USER_PATTERN


def schema_ok(df: DataFrame, expected: list[str]) -> bool:
    """Exact names in order; no job runs."""
    return df.columns == list(expected)


def timestamps(df: DataFrame, col: str = "ts") -> DataFrame:
    day = F.to_date(col)
    return df.agg(F.count_if(F.col(col).isNull()).alias("unparseable"), F.min(col).alias("first"), F.max(col).alias("last"), F.countDistinct(day).alias("n_days"))


def ids(df: DataFrame, col: str = "id", pattern: str = ID_PATTERN) -> DataFrame:
    """Repeated ids (nulls repeat each other) and ids of another form (null is one)."""
    text = F.col(col).cast("string")
    return df.agg((F.count(F.lit(1)) - F.countDistinct(F.struct(col))).alias("duplicate_ids"), F.count_if(~F.coalesce(text.rlike(pattern), F.lit(False))).alias("bad_format"))


def missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_missing), from one pass."""
    names = cols or df.columns
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in names])).alias("x")).select("x.*")


def duplicates(df: DataFrame) -> DataFrame:
    return df.agg((F.count(F.lit(1)) - F.countDistinct(F.struct(*df.columns))).alias("duplicate_rows"))


def allowed_values(df: DataFrame, col: str, allowed: list) -> DataFrame:
    return df.agg(F.count_if(~F.coalesce(F.col(col).isin(list(allowed)), F.lit(False))).alias("outside"))


def pattern(df: DataFrame, col: str, regex: str) -> DataFrame:
    return df.agg(F.count_if(~F.coalesce(F.col(col).rlike(regex), F.lit(False))).alias("bad_format"))


def user_ids(df: DataFrame, col: str = "user") -> DataFrame:
    return pattern(df, col, USER_PATTERN)


def pc_ids(df: DataFrame, col: str = "pc") -> DataFrame:
    return pattern(df, col, PC_PATTERN)


def numeric_range(df: DataFrame, col: str, lo, hi) -> DataFrame:
    return df.agg(F.count_if((F.col(col) < lo) | (F.col(col) > hi)).alias("outside"))


def user_coverage(population: DataFrame, files: Mapping[str, DataFrame], col: str = "user_id") -> DataFrame:
    """(file, n_users, missing, extra) of each file against the population."""
    known = population.select(col).distinct().withColumn("p", F.lit(1))
    parts = []
    for name, df in files.items():
        both = known.join(df.select(col).distinct().withColumn("f", F.lit(1)), col, "full_outer")
        parts.append(both.agg(F.sum("f").alias("n_users"), F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("p").isNull()).alias("extra")).select(F.lit(name).alias("file"), F.coalesce("n_users", F.lit(0)).alias("n_users"), "missing", "extra"))
    return reduce(DataFrame.unionByName, parts)


def label_audit(incidents: DataFrame, population: DataFrame, col: str = "user_id") -> DataFrame:
    """(scenario, n): incidents of each scenario; scenario null: all, with users, bad dates and users outside the population."""
    known = population.select(col).distinct().withColumn("__known", F.lit(1))
    rows = incidents.join(known, col, "left")
    return rows.groupingSets([[F.col("scenario")], []], F.col("scenario")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(col).alias("n_users"), F.count_if(F.col("start").isNull() | F.col("end").isNull()).alias("bad_dates"), F.countDistinct(F.when(F.col("__known").isNull(), F.col(col))).alias("unknown_users")
    )


def file_battery(df: DataFrame, name: str, checks: Mapping[str, Column]) -> DataFrame:
    """(file, check, value, ok) of counts that must be 0, and the number of repeated rows, all from one pass."""
    names = list(checks)
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.coalesce(checks[c], F.lit(True))).alias(c) for c in names], (F.count(F.lit(1)) - F.countDistinct(F.struct(*df.columns))).alias("repeated_rows"))
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("value")) for c in [*names, "repeated_rows"]])
    return one.select(F.lit(name).alias("file"), F.explode(rows).alias("x")).select("file", "x.check", "x.value", (F.col("x.value") == 0).alias("ok"))


def standard_checks(df: DataFrame) -> dict[str, Column]:
    """The checks of a raw log by the columns it has: rows that are wrong."""
    wrong = lambda c, regex: ~F.coalesce(F.col(c).rlike(regex), F.lit(False))
    every = {
        "id": ("bad_id", lambda c: wrong(c, ID_PATTERN)), "ts": ("bad_date", lambda c: F.col(c).isNull()), "user": ("bad_user", lambda c: wrong(c, USER_PATTERN)), "pc": ("bad_pc", lambda c: wrong(c, PC_PATTERN)),
        "activity": ("unknown_activity", lambda c: ~F.coalesce(F.col(c).isin("Logon", "Logoff", "Connect", "Disconnect"), F.lit(False))), "size": ("bad_size", lambda c: F.coalesce(F.col(c) < 0, F.lit(True))),
    }
    return {name: check(c) for c, (name, check) in every.items() if c in df.columns}


def run_validation(logs: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Every check of every log given by name (logon, device, file, http, email, psychometric), and their summary."""
    batteries = [file_battery(df, name, standard_checks(df)) for name, df in logs.items()]
    return reduce(DataFrame.unionByName, batteries), summary(batteries)


def summary(batteries: list[DataFrame]) -> DataFrame:
    """(file, n_checks, n_failed, ok), and a row with a null file for all."""
    rows = reduce(DataFrame.unionByName, batteries)
    return rows.groupingSets([[F.col("file")], []], F.col("file")).agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("ok")).alias("n_failed"), F.bool_and("ok").alias("ok"))
