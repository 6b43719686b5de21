"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise, partitions, scope


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the seed and the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), _text(id_col)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2, ... as an array, to where nothing is left."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.when(k > 0, F.log(rate) - F.log(k.cast("double"))).otherwise(F.lit(0.0))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    start = F.struct((-rate).alias("log_p"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("steps"))
    return F.aggregate(F.sequence(F.lit(0), top), start, step, lambda acc: acc["steps"])


#: Mean rates up to this have steps from 0; beyond, only those counts have that are not as good as impossible.
SMALL = 1000.0


def _log_factorial(k: Column) -> Column:
    """ln k!, by the factorial itself up to 20 and Stirling's series beyond (within 1e-12)."""
    d = k.cast("double")
    series = d * F.log(d) - d + F.log(d * (2 * math.pi)) / 2 + 1 / (12 * d) - 1 / (360 * d**3) + 1 / (1260 * d**5)
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(__source, __base, __steps) from (__source, __rate): cumulative probabilities of __base, __base + 1, ...

    Twelve deviations to each side of the mean are more than a double can tell,
    so a source has 24 times the root of its rate steps at most, each from a
    closed form, summed up in the order of the counts.
    """
    small = rates.filter(F.col("__rate") <= SMALL).select("__source", F.lit(0).cast("long").alias("__base"), poisson_steps(F.col("__rate")).alias("__steps"))
    wide = 12 * F.sqrt("__rate")
    large = rates.filter(F.col("__rate") > SMALL).withColumn("__base", F.floor(F.col("__rate") - wide).cast("long"))
    counts = large.select("__source", "__rate", "__base", F.explode(F.sequence("__base", F.ceil(F.col("__rate") + wide).cast("long"))).alias("k"))
    k = F.col("k")
    one = counts.select("__source", "__base", "k", F.exp(k * F.log("__rate") - F.col("__rate") - _log_factorial(k)).alias("p"))
    upto = one.withColumn("c", F.sum("p").over(Window.partitionBy("__source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    held = upto.groupBy("__source", "__base").agg(F.sort_array(F.collect_list("c")).alias("__steps"))
    return small.unionByName(held)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", id_col: str = "doc_id", total: float | None = None, seed: int = 42) -> DataFrame:
    """Rows of ``docs`` replicated so that each source reaches its share of ``total`` rows, in a random global order.

    A source's mean rate is its share of the weights times ``total`` (default:
    the rows there are) over its own rows; a row's count is the Poisson
    quantile of a number hashed from seed and id, so it is the same on every
    run. Without ``weights`` all sources weigh the same; a source that
    ``weights`` doesn't name, or weighs 0, is left out. A null source is a
    source of its own, and a null id hashes as the text ``null``; rows with one
    id get one count. Adds ``copy`` (from 1) and ``shuffle_key`` (md5), which
    replace columns of those names. An empty table gives an empty result.
    """
    with scope() as kept:
        spark = docs.sparkSession
        sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count(F.lit(1)).alias("__rows"))
        if weights is None:
            sizes = sizes.withColumn("__weight", F.lit(1.0))
        else:
            given = spark.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "__name string, __weight double")
            sizes = sizes.join(given, F.col("__source").cast("string").eqNullSafe(F.col("__name"))).drop("__name")
        sizes = materialise(sizes, "sources")
        whole = sizes.agg(F.sum("__weight").alias("w"), F.sum("__rows").alias("n")).first()
        goal = float(whole["n"] or 0) if total is None else float(total)
        rate = F.col("__weight") / F.lit(float(whole["w"] or 1)) * goal / F.col("__rows")
        rates = materialise(poisson_tables(sizes.select("__source", rate.alias("__rate"))), "rates")
        kept += [rates]
        names = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
        joined = docs.join(rates, F.col(source_col).eqNullSafe(F.col("__source")))
        counted = joined.withColumn("__u", uniform(id_col, seed)).withColumn("__n", F.col("__base") + F.size(F.filter("__steps", lambda c: c <= F.col("__u"))))
        copies = counted.filter("__n > 0").select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("copy"))
        key = F.md5(F.concat(F.lit(f"{seed}:"), _text(id_col), F.lit(":"), F.col("copy").cast("string")).cast("binary"))
        return copies.withColumn("shuffle_key", key).repartition(partitions(spark), "shuffle_key").sortWithinPartitions("shuffle_key")


def mix_sql(seed: int = 42) -> str:
    """The same with equal weights, for DuckDB."""
    return f"""
WITH s AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
     r AS (SELECT source, (1.0 / (SELECT count(*) FROM s)) * (SELECT sum(n) FROM s) / n AS rate FROM s),
     p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS c
           FROM r, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k) t),
     u AS (SELECT *, CAST(('0x' || substr(md5('{seed}:' || doc_id), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM documents),
     c AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(p.k) AS n FROM u JOIN p ON p.source = u.source AND p.c <= u.u GROUP BY ALL),
     e AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM c)
SELECT *, md5('{seed}:' || doc_id || ':' || copy) AS shuffle_key FROM e"""
