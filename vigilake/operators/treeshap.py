"""Additive contributions of boosted trees: exact Shapley values of each tree, by its leaves, in Arrow batches.

The value of a set of known features is the mean of a tree over its training
rows that the known values allow (weighted by the rows that went each way where a
feature is unknown). Along the path to a leaf that is a product over the path's
features, so the Shapley values need only the subsets of one path.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A leaf: its value and, for each feature on its path, (feature, low, high, share of rows that pass); a row passes if low < x <= high.
Leaf = tuple[float, list[tuple[int, float, float, float]]]


def leaves_of(node, weight: float = 1.0, path: dict[int, tuple[float, float, float]] | None = None) -> list[Leaf]:
    """The leaves of a fitted tree's (JVM) node; conditions on one feature are one interval."""
    path = path or {}
    if node.subtreeDepth() == 0:
        return [(weight * node.prediction(), [(f, *x) for f, x in sorted(path.items())])]
    f, cut = node.split().featureIndex(), node.split().threshold()
    left, right = node.leftChild(), node.rightChild()
    rows = node.impurityStats().count()
    found: list[Leaf] = []
    for child, is_left in ((left, True), (right, False)):
        lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
        own = (lo, min(hi, cut)) if is_left else (max(lo, cut), hi)
        found += leaves_of(child, weight, path | {f: (*own, share * child.impurityStats().count() / rows)})
    return found


def export(model) -> list[Leaf]:
    """All leaves of a fitted pyspark.ml tree ensemble, weighted as its margin weighs them."""
    trees = zip(model.trees, model.treeWeights, strict=True)
    return [leaf for t, w in trees for leaf in leaves_of(t._call_java("rootNode"), float(w))]


def expected(leaves: list[Leaf]) -> float:
    return float(sum(v * np.prod([s for *_, s in path]) for v, path in leaves))


def shapley(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Contributions (rows, features) to the margin; with :func:`expected` they add up to it."""
    out = np.zeros(x.shape)
    for value, path in leaves:
        n = len(path)
        passes = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi, _ in path]
        for j, (f, _, _, share) in enumerate(path):
            rest = [i for i in range(n) if i != j]
            total = np.zeros(len(x))
            for size in range(n):
                w = factorial(size) * factorial(n - size - 1) / factorial(n)
                for known in combinations(rest, size):
                    term = np.full(len(x), w * np.prod([path[i][3] for i in rest if i not in known]))
                    for i in known:
                        term *= passes[i]
                    total += term
            out[:, f] += value * (passes[j] - share) * total
    return out


def tree_contributions(model, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``keep``, the features, ``margin``, ``bias`` and ``contribution_<feature>`` of each row; ``model`` is what :func:`vigilake.operators.learned.fit_trees` gives."""
    assembler, fitted = model
    leaves = export(fitted)
    bias = expected(leaves)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = pdf[features].to_numpy(float)
            made = shapley(x, leaves)
            margin = np.zeros(len(x))
            for value, path in leaves:
                inside = np.ones(len(x), bool)
                for f, lo, hi, _ in path:
                    inside &= (x[:, f] > lo) & (x[:, f] <= hi)
                margin += value * inside
            yield pdf.assign(margin=margin, bias=bias, **{f"contribution_{f}": made[:, i] for i, f in enumerate(features)})

    rows = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInPandas(run, ", ".join([*kinds, "margin double", "bias double", *[f"`contribution_{f}` double" for f in features]]))


def alert_patterns(df: DataFrame, features: list[str]) -> DataFrame:
    """Over rows with contributions, of each feature: how often it is the largest upward, the largest downward and among the three largest, its signs and its mean."""
    part = [F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f"contribution_{f}").alias("c")) for i, f in enumerate(features)]
    rows = df.select(F.array(*part).alias("x"))
    up = F.array_sort(F.transform(F.filter("x", lambda e: e["c"] > 0), lambda e: F.struct((-e["c"]).alias("o"), e["i"].alias("i"))))
    down = F.array_sort(F.transform(F.filter("x", lambda e: e["c"] < 0), lambda e: F.struct(e["c"].alias("o"), e["i"].alias("i"))))
    large = F.array_sort(F.transform(F.filter("x", lambda e: e["c"] != 0), lambda e: F.struct((-F.abs(e["c"])).alias("o"), e["i"].alias("i"))))
    ranked = rows.select("x", F.get(up, F.lit(0))["i"].alias("up"), F.get(down, F.lit(0))["i"].alias("down"), F.transform(large, lambda e: e["i"]).alias("order"))
    long = ranked.select("up", "down", "order", F.explode("x").alias("e")).withColumn("rank", F.array_position("order", F.col("e.i")))
    i, c = F.col("e.i"), F.col("e.c")
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("int"))
    return long.groupBy(F.col("e.feature").alias("feature")).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("up") == i).alias("top_up"), share(F.col("down") == i).alias("top_down"), share((F.col("rank") >= 1) & (F.col("rank") <= 3)).alias("top3"),
        share(c > 0).alias("positive"), share(c < 0).alias("negative"), share(c == 0).alias("zero"), F.avg(c).alias("mean"), F.avg(F.abs(c)).alias("mean_abs"),
        F.avg(F.when(F.col("rank") > 0, F.col("rank"))).alias("mean_rank"), share(F.col("rank") == 1).alias("top1"), share((F.col("rank") >= 1) & (F.col("rank") <= 2)).alias("top2"),
    )
