"""Learning and comparing ways to fuse risk components: weight grids, families, arms, nested folds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.scalar import logit, sigmoid
from vigilake.operators import components, learned, metrics, resampling
from vigilake.operators.policies import policy_metrics
from vigilake.sources.scratch import written

PARTS = ["r_ml", "r_trust", "r_context", "r_behavior"]


def grid_metrics(df: DataFrame, parts: list[str], grid: DataFrame, label: str = "is_malicious") -> DataFrame:
    """(weights, roc_auc, pr_auc) of each point (w_0, w_1, ...) of a grid; rows are counted by score before they meet in one running sum."""
    points = grid.agg(F.collect_list(F.array(*grid.columns)).alias("g"))  # a grid has tens of points
    rows = df.select(*parts, F.col(label).alias("y")).crossJoin(F.broadcast(points)).select(*parts, "y", F.explode("g").alias("weights"))
    score = reduce(lambda a, b: a + b, [F.col("weights")[i] * F.col(p) for i, p in enumerate(parts)])
    return metrics.ranking_by(rows.select("weights", F.round(score, 12).alias("score"), "y"), ["weights"]).select("weights", "roc_auc", "pr_auc")


def learn_weights(train: DataFrame, calibration: DataFrame, parts: list[str], step: float = 0.1, top: int = 20, label: str = "is_malicious") -> DataFrame:
    """(weights, train_pr_auc, calibration_pr_auc, train_roc_auc, calibration_roc_auc, chosen): the ``top`` points of the simplex grid by training average precision.

    ``chosen`` marks the one with the best calibration average precision; ties go to smaller weights
    in training and to larger ones in calibration.
    """
    grid = components.simplex_grid(train.sparkSession, len(parts), step)
    first = grid_metrics(train, parts, grid, label).select("weights", F.col("pr_auc").alias("train_pr_auc"), F.col("roc_auc").alias("train_roc_auc"))
    best = first.orderBy(F.desc("train_pr_auc"), "weights").limit(top)
    both = best.join(grid_metrics(calibration, parts, grid, label).select("weights", F.col("pr_auc").alias("calibration_pr_auc"), F.col("roc_auc").alias("calibration_roc_auc")), "weights")
    both = written(both, "grid")  # top rows
    winner = both.agg(F.max(F.struct("calibration_pr_auc", "weights")).alias("x")).select(F.col("x.weights").alias("__w"))
    return both.crossJoin(F.broadcast(winner)).withColumn("chosen", F.col("weights") == F.col("__w")).drop("__w")


def component_block(block: DataFrame, train: DataFrame, roles: DataFrame, behaviour: list[str], trust: list[str], context: list[str]) -> DataFrame:
    """(user_id, day, r_trust, r_context, r_behavior) of the rows of ``block``; trust is fitted on ``train``, peers come from the block's users."""
    keys = ["user_id", "day"]
    b = components.behaviour_risk(block, behaviour).select(*keys, "r_behavior")
    t = components.trust_risk(train, block, trust).select(*keys, "r_trust")
    own = roles.join(block.select("user_id").distinct(), "user_id", "left_semi")
    c = components.context_risk(block.select(*keys, *context), components.peers(own), context).select(*keys, "r_context")
    return t.join(c, keys).join(b, keys)


def ml_logit(ml: Column) -> Column:
    return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), logit(ml)))


def _logistic(train: DataFrame, inputs: dict[str, Column], l2: float, label: str) -> tuple[dict[str, float], float]:
    """Weights and intercept of a ridge logistic regression whose penalty is l2 / 2 of the squared weights against the summed loss."""
    held = train.select(F.col(label).alias(label), *[c.alias(n) for n, c in inputs.items()])
    n = held.count()
    _, model = learned.fit_logistic(held, list(inputs), label, l2 / max(n, 1))
    return dict(zip(inputs, map(float, model.coefficients.toArray()), strict=True)), float(model.intercept)


def _linear(weights: dict[str, float], inputs: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * inputs[n] for n, w in weights.items()], F.lit(0.0))


def apply_family(train: DataFrame, df: DataFrame, family: str, setting: float | None = None, out: str = "fused", label: str = "is_malicious") -> DataFrame:
    """``df`` (user_id, day, PARTS) with the score of a family fitted on ``train``.

    A0: the model alone. B: fusion weights on the simplex. C: a logistic regression over the model's logit and the
    components (setting: inverse penalty). D: the model's logit plus non-negative weights on the components
    (penalty); E: and on their products. F1, F2: D and E smoothed along each user's days (setting: the share that
    persists). G: summed log ratios of class counts in equal-width bins. Gated and sequence families (H, I, J): equal
    weights, as no deep-learning library is there.
    """
    ml, others = PARTS[0], PARTS[1:]
    if family == "A0":
        return df.withColumn(out, F.col(ml))
    if family == "B":
        return components.weighted(df, components.fit_fusion(train, PARTS, label), out)
    if family == "C":
        inputs = {"logit": ml_logit(F.col(ml))} | {c: F.col(c) for c in others}
        w, b = _logistic(train, inputs, 1 / (1.0 if setting is None else setting), label)
        return df.withColumn(out, sigmoid(_linear(w, inputs) + b))
    if family in ("D", "E"):
        more = (lambda rows: (rows, others)) if family == "D" else (lambda rows: learned.with_interactions(rows, others))
        (rows, names), (held, _) = more(train), more(df)
        w, _ = _logistic(rows, {c: F.col(c) for c in names}, 0.1 if setting is None else setting, label)
        return components.residual_logistic(held, ml, w, out).select(*df.columns, out)
    if family in ("F1", "F2"):
        once = apply_family(train, df, "D" if family == "F1" else "E", 0.1, "__once", label)
        return components.ewma(once, setting, "__once", out).drop("__once") if setting else once.withColumnRenamed("__once", out)
    if family == "G":
        return components.score_binned_ratios(df, components.fit_binned_ratios(train, PARTS, label), PARTS, out=out)
    if family[:1] in ("H", "I", "J"):
        return components.equal_weights(df, PARTS, out)
    raise ValueError(f"unknown family: {family}")


def evaluate_arm(calibration: DataFrame, test: DataFrame, score: str = "fused", label: str = "is_malicious") -> DataFrame:
    """One row: the best-F1 threshold on calibration, the test metrics of its alerts, ranking, ties and coverage of users."""
    t = metrics.best_f1_threshold(calibration, score, label).select("threshold", F.col("f1").alias("calibration_f1"))
    held = test.crossJoin(F.broadcast(t)).withColumn("alert", F.col(score) >= F.col("threshold"))  # one row
    rank = metrics.ranking_metrics(test, score, label).select("roc_auc", "pr_auc")
    ties = metrics.tie_audit(test, score).select("tied_share")
    users = metrics.coverage(metrics.detection(held, label)).select("n_users", F.col("n_detected").alias("n_users_detected"))
    days = test.agg(F.countDistinct("day").alias("n_days"))
    one = metrics.binary_metrics(held, F.col("alert"), F.col(label)).crossJoin(t).crossJoin(rank).crossJoin(ties).crossJoin(users).crossJoin(days)  # one row each
    return one.withColumn("alerts_per_day", F.col("n_alerts") / F.greatest("n_days", F.lit(1)))


def run_arm(train: DataFrame, calibration: DataFrame, test: DataFrame, features: list[str], label: str = "is_malicious", **how) -> DataFrame:
    """One row of :func:`evaluate_arm` for boosted trees over ``features``, stopped by the calibration block."""
    model = learned.fit_trees(train, features, label, validation=calibration, **how)
    scored = lambda df: learned.predict(model, df.drop("score", "fused"), "fused")
    return evaluate_arm(scored(calibration), scored(test), label=label)


def user_holdout(df: DataFrame, features: list[str], label: str = "is_malicious", **how) -> DataFrame:
    """:func:`run_arm` on users that no other block has: blocks come from :func:`vigilake.operators.resampling.allocate`."""
    held = written(df.join(resampling.allocate(df, label).select("user_id", "block"), "user_id"), "blocks")
    part = lambda b: held.filter(F.col("block") == b).drop("block")
    return run_arm(part("train"), part("calibration"), part("test"), features, label, **how)


#: Models or families that are fitted at the same time.
AT_ONCE = 8


def _at_once(spark: SparkSession, jobs: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """What the jobs return, in their order, AT_ONCE of them at a time."""
    with ThreadPool(min(AT_ONCE, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, 1)


def nested_cv(df: DataFrame, features: list[str], roles: DataFrame, families: list[tuple[str, float | None]], behaviour: list[str], trust: list[str], context: list[str], folds: int = 5, label: str = "is_malicious", done: Callable[[int], bool] = lambda k: False, **how) -> DataFrame:
    """(fold, family, threshold, f1, n_alerts, precision, recall, mcc, roc_auc, pr_auc): each family fitted on four fifths of the users and judged on the rest.

    Folds deal users round robin; the model's scores of a fold's training users are out of fold
    too. A fold that ``done`` names is skipped, as on a resumed run. What folds share is computed once: a user's behaviour
    hangs on own days alone, trust counts values by fold, and the pools of all folds' training and held-out users are
    taken in one pass. Models and families, whose jobs are small, are fitted several at once.
    """
    keys, inner = ["user_id", "day"], 3
    todo = [k for k in range(folds) if not done(k)]
    if not todo:
        raise ValueError("all folds are done")
    spark, fold = df.sparkSession, F.col("fold")
    dealt = written(df.drop("score", "fold").join(resampling.round_robin(df, folds), "user_id"), "folds")
    blocks = dealt.select("user_id", "fold").distinct().select("user_id", "fold", F.explode(F.array(*[F.lit(k) for k in todo])).alias("k")).withColumn("held", fold == F.col("k"))
    blocks = written(blocks.drop("fold"), "blocks")
    again = resampling.round_robin_by(blocks.filter("not held").select("k", "user_id"), inner, ["k"]).groupBy("user_id").agg(*[F.max(F.when(F.col("k") == k, F.col("fold"))).alias(f"inner_{k}") for k in todo])
    base = components.trust_by_fold(components.behaviour_risk(dealt, behaviour), trust, todo)
    base = written(base.join(again, "user_id", "left"), "components")

    def scored(k: int, j: int | None) -> DataFrame:
        """Rows with the model's score: the held-out ones of fold k, or the training ones of its inner fold j."""
        own = base.filter(fold == k) if j is None else base.filter((fold != k) & (F.col(f"inner_{k}") == j))
        rest = base.filter(fold != k) if j is None else base.filter((fold != k) & (F.col(f"inner_{k}") != j))
        found = learned.predict(learned.fit_trees(rest, features, label, **how), own, "r_ml")
        return found.select(*keys, label, "r_ml", "r_behavior", F.col(f"r_trust_{k}").alias("r_trust"), *[c for c in dict.fromkeys(context) if c != label], F.lit(k).alias("k"), F.lit(j is None).alias("held"))

    parts = _at_once(spark, [lambda k=k, j=j: scored(k, j) for k in todo for j in (None, *range(inner))])
    every = written(reduce(DataFrame.unionByName, parts), "models")
    pools = components.peers(roles.join(blocks, "user_id"), by=("k", "held"))
    every = written(components.context_risk(every, pools, context, on=("k", "held", "user_id")).select("k", "held", *keys, label, *PARTS), "components")

    def fused(k: int, at: int) -> DataFrame:
        (family, setting), (train, val) = families[at], (every.filter((F.col("k") == k) & c).drop("k", "held") for c in (~F.col("held"), F.col("held")))
        own = apply_family(train, val, family, setting, label=label).select("fused", label)
        return written(own.select(F.lit(k).alias("fold"), F.lit(at).alias("place"), "*"), "fused")

    by = ["fold", "place"]
    scores = written(reduce(DataFrame.unionByName, _at_once(spark, [lambda k=k, at=at: fused(k, at) for k in todo for at in range(len(families))])), "fused")
    t = written(metrics.best_f1(scores.filter("fused is not null").groupBy(*by, F.col("fused").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos")), by), "thresholds")
    alerts = scores.join(F.broadcast(t.select(*by, "threshold")), by, "left")  # a row each fold and family
    own = metrics.binary_metrics(alerts, F.col("fused") >= F.col("threshold"), F.col(label), by).select(*by, "n_alerts", "precision", "recall", "mcc")
    rank = metrics.ranking_by(scores, by, "fused", label).select(*by, "roc_auc", "pr_auc")
    asked = spark.createDataFrame([(k, at, f) for k in todo for at, (f, _) in enumerate(families)], "fold int, place int, family string")
    row = asked.join(t, by, "left").join(own, by, "left").join(rank, by, "left").na.fill(0, ["n_alerts", "precision", "recall", "mcc"])
    return row.orderBy(*by).select("fold", "family", "threshold", "f1", "n_alerts", "precision", "recall", "mcc", "roc_auc", "pr_auc")


def combined_policies(df: DataFrame, frozen: float, days: tuple[int, ...] = (7, 14), windows: tuple[int, ...] = (1, 3, 7), label: str = "is_malicious", score: str = "score") -> DataFrame:
    """The metrics of policies P0 to P4, by ``policy``: the frozen threshold, with 1, 3 and 7 days of suppression, and rolling thresholds with the chosen suppression.

    The rolling window is the one of ``days`` with the best F1 over all windows (then recall); the suppression of P4 is the one that
    :func:`vigilake.operators.policies.select_operational` chooses among P1 to P3, none if it keeps P0.
    """
    from vigilake.operators import policies

    base = written(policies.threshold_mask(df, frozen, score), "policy")
    own = lambda name, rows: policy_metrics(rows, label).select(F.lit(name).alias("policy"), "*")
    table = own("P0", base)
    for i, w in enumerate(windows):
        table = table.unionByName(own(f"P{i + 1}", policies.suppress(base, w).withColumn("alert", F.col("emitted"))))
    table = written(table, "policies")
    choice = policies.select_operational(table).select("policy").first()["policy"]
    suppressed = {"P0": 0} | {f"P{i + 1}": w for i, w in enumerate(windows)}
    rolled = {d: written(policies.apply_rolling(df, policies.rolling_thresholds(df, d, frozen, label, score), d, score).drop("window", "threshold"), "rolling") for d in days}
    ranked = [(metrics.binary_metrics(r, F.col("alert"), F.col(label)).select("f1", "recall").first(), -d) for d, r in rolled.items()]
    best = rolled[-max(ranked, key=lambda x: (x[0]["f1"], x[0]["recall"], x[1]))[1]]
    if suppressed[choice]:
        best = policies.suppress(best, suppressed[choice]).withColumn("alert", F.col("emitted"))
    return table.unionByName(own("P4", best))
