"""Model scores by pyspark.ml: gradient-boosted trees, logistic stacking, out-of-fold scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_features(df: DataFrame, features: list[str]) -> list[str]:
    gone = [f for f in features if f not in df.columns]
    if gone:
        raise ValueError(f"missing features: {gone}")
    return features


def check_order(df: DataFrame, features: list[str], keys: tuple[str, ...] = ("user_id", "day")) -> list[str]:
    """The features, if they are all that ``df`` has besides ``keys``, in that order; else an error names what differs."""
    have = [c for c in df.columns if c not in keys]
    if have != features:
        raise ValueError(f"missing: {[f for f in features if f not in have]}, extra: {[c for c in have if c not in features]}, order: {have}")
    return features


def _with_weights(df: DataFrame, label: str) -> DataFrame:
    """Positives weigh as many rows as there are negatives to each."""
    ratio = F.broadcast(df.agg(((F.count(F.lit(1)) - F.sum(label)) / F.greatest(F.sum(label), F.lit(1))).alias("__ratio")))
    return df.crossJoin(ratio).withColumn("__w", F.when(F.col(label) == 1, F.greatest("__ratio", F.lit(1.0))).otherwise(F.lit(1.0))).withColumn("__y", F.col(label).cast("double"))  # one row


def fit_trees(train: DataFrame, features: list[str], label: str = "is_malicious", validation: DataFrame | None = None, rounds: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42):
    """Boosted trees with class weights; with ``validation`` they stop when its error no longer falls."""
    assembler = VectorAssembler(inputCols=check_features(train, features), outputCol="__x")
    rows = _with_weights(train, label)
    gbt = GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed)
    if validation is not None:
        rows = rows.withColumn("__v", F.lit(False)).unionByName(_with_weights(validation.select(*train.columns), label).withColumn("__v", F.lit(True)))
        gbt = gbt.setValidationIndicatorCol("__v")
    return assembler, gbt.fit(assembler.transform(rows))


def predict(model, df: DataFrame, out: str = "score") -> DataFrame:
    assembler, fitted = model
    made = {"rawPrediction", "probability", "prediction", "__x"}
    return fitted.transform(assembler.transform(df)).withColumn(out, vector_to_array("probability")[1]).drop(*made)


def margin(model, df: DataFrame, out: str = "margin") -> DataFrame:
    """``df`` with the trees' summed and weighted predictions for class 1."""
    assembler, fitted = model
    made = {"rawPrediction", "probability", "prediction", "__x"}
    return fitted.transform(assembler.transform(df)).withColumn(out, vector_to_array("rawPrediction")[1]).drop(*made)


def importances(model, features: list[str]) -> dict[str, float]:
    """Each feature's share of the gain."""
    gain = model[1].featureImportances.toArray()
    return dict(zip(features, (gain / max(gain.sum(), 1e-12)).tolist(), strict=True))


def fit_logistic(train: DataFrame, features: list[str], label: str = "is_malicious", l2: float = 0.1, non_negative: bool = False):
    assembler = VectorAssembler(inputCols=check_features(train, features), outputCol="__x")
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=l2, standardization=False)
    if non_negative:
        from pyspark.ml.linalg import Matrices

        model = model.setLowerBoundsOnCoefficients(Matrices.dense(1, len(features), [0.0] * len(features)))
    return assembler, model.fit(assembler.transform(train.withColumn("__y", F.col(label).cast("double"))))


def with_interactions(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Products of all pairs of the columns, beside them."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs}), [*columns, *[f"{a}_x_{b}" for a, b in pairs]]


def out_of_fold(df: DataFrame, folds: DataFrame, n: int, fit: Callable[[DataFrame], object], out: str = "oof") -> DataFrame:
    """Scores of each fold by a model of the others: no row is scored by a model that saw its user."""
    held = df.join(folds, "user_id")
    parts = [predict(fit(held.filter(F.col("fold") != k).drop("fold")), held.filter(F.col("fold") == k), out) for k in range(n)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def seed_sweep(train: DataFrame, features: list[str], seeds: tuple[int, ...] = (1, 2, 3), **how) -> DataFrame:
    """(feature, mean_share, min_share, max_share) of the gain over models that differ in their seed."""
    rows = [(s, f, v) for s in seeds for f, v in importances(fit_trees(train, features, seed=s, **how), features).items()]
    table = train.sparkSession.createDataFrame(rows, "seed int, feature string, share double")
    return table.groupBy("feature").agg(F.avg("share").alias("mean_share"), F.min("share").alias("min_share"), F.max("share").alias("max_share"))
