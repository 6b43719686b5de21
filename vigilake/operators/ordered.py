"""Running sums and ranks over a whole ordered table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SAMPLE = 4000


def running(df: DataFrame, value: str, sums: dict[str, Column], descending: bool = False, parts: int | None = None) -> DataFrame:
    """``df`` with, for each name, the sum up to and including the row in the order of ``value``.

    ``value`` is unique and of any type that has an order (descending: numeric).
    A sample of bounded size, the values with the least hashes, cuts the table into ``parts`` ranges
    (default: the shuffle partitions, 64 at least); the ranges' totals are summed in one
    task and sent back, and the rest of each sum is taken within its range.
    """
    parts = parts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    v = -F.col(value) if descending else F.col(value)
    sample = df.filter(v.isNotNull()).select(v.alias("v")).orderBy(F.xxhash64("v")).limit(SAMPLE)
    cuts = sample.agg(F.sort_array(F.collect_list("v")).alias("s"))
    every = F.greatest(F.ceil(F.size("s") / parts), F.lit(1))
    cuts = cuts.select(F.filter("s", lambda x, i: (i + 1) % every == 0).alias("__cuts"))
    held = df.withColumns({f"__{n}": c for n, c in sums.items()}).crossJoin(F.broadcast(cuts))  # one row
    held = held.withColumn("__part", F.size(F.filter("__cuts", lambda c: c < v))).drop("__cuts")
    totals = held.groupBy("__part").agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    within = Window.partitionBy("__part").orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(F.broadcast(bases), "__part")
    out = out.withColumns({n: F.sum(f"__{n}").over(within) + F.col(f"__b_{n}") for n in sums})
    return out.drop("__part", *[f"__{n}" for n in sums], *[f"__b_{n}" for n in sums])


def by_score(df: DataFrame, score: str = "score", label: str = "y", weight: Column | None = None) -> DataFrame:
    """(score, n, pos): rows and positives of each distinct score."""
    w = F.lit(1) if weight is None else weight
    return df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("pos"))
