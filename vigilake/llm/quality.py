"""Quality scores from a sparse rule ensemble: tree paths as rules, lasso logistic weights, compiled to columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .scratch import materialise

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, cut) of each condition


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; null counts as empty and all are finite."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.split(t, "\n")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    marks = F.regexp_replace(t, r"[^!-/:-@\[-`{-~]+", "")
    share = lambda pattern, of: F.length(F.regexp_replace(of, pattern, "")) / n
    return {
        "chars": F.log1p(F.length(t).cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "lines": F.log1p(F.size(lines).cast("double")),
        "word_length": n / n_words,
        "line_length": F.log1p(n / F.size(lines)),
        "upper": share(r"[^\p{Lu}]+", t),
        "digits": share(r"[^0-9]+", t),
        "marks": F.length(marks) / n,
        "symbols": share(r"[.,;:'\"!?()-]+", marks),
        "shouts": share(r"[^!]+", marks),
        "bars": share(r"[^|]+", marks),
        "stops": share(r"[^.]+", marks),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
    }


def _grow(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """Paths of one regression tree, as ((column, above, cut), ...), and its step for each row."""
    paths, step = [], np.zeros(len(x))
    todo = [((), np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        g, h = grad[rows], hess[rows]
        best = (1e-6, None, None)
        if len(path) < depth and len(rows) >= 2 * least:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for j, edges in enumerate(cuts):
                if not len(edges):
                    continue
                b = bins[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(edges) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            step[rows] = -g.sum() / (h.sum() + 1)
            continue
        _, j, k = best
        above = bins[rows, j] > k
        for side in (False, True):
            own = (*path, (j, side, float(cuts[j][k])))
            paths.append(own)
            todo.append((own, rows[above == side]))
    return paths, step


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, rate: float = 0.3, penalties: tuple[float, ...] = (0.02, 0.005, 0.001, 0.0002)) -> tuple[float, list[tuple[Rule, float]]]:
    """Bias and the rules with a weight that is not 0; the penalty is chosen on every fifth row."""
    if not len(y):
        return 0.0, []
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(base / (1 - base)))
    if y.min() == y.max():
        return bias, []
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, 34)[1:-1])) for col in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    margin, rules = np.full(len(y), bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, step = _grow(x, cuts, bins, p - y, p * (1 - p), depth, max(5, len(y) // 500))
        margin += rate * step
        rules |= dict.fromkeys(tuple(sorted(path)) for path in paths)
    rules = list(rules)
    fires = np.stack([np.logical_and.reduce([(x[:, j] > cut) == above for j, above, cut in r]) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    spread = fires.std(axis=0) + 1e-9
    z = (fires - fires.mean(axis=0)) / spread
    check = np.arange(len(y)) % 5 == 0

    def lasso(rows: np.ndarray, penalty: float, w: np.ndarray) -> np.ndarray:
        a, t, own, mine = w.copy(), 1.0, z[rows], y[rows]
        whole = np.hstack([np.ones((len(own), 1)), own])
        probe = np.ones(whole.shape[1])
        for _ in range(20):
            probe = whole.T @ (whole @ (probe / np.linalg.norm(probe)))
        pace = 4 * len(own) / np.linalg.norm(probe)
        for _ in range(300):
            p = 1 / (1 + np.exp(-whole @ a))
            new = a - pace * (whole.T @ (p - mine)) / len(own)
            new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - pace * penalty, 0)
            t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            a, w = new + (last - 1) / t * (new - w), new
        return w

    best, w = (np.inf, penalties[-1]), np.zeros(len(rules) + 1)
    w[0] = bias
    for penalty in penalties:
        w = lasso(np.flatnonzero(~check), penalty, w)
        p = np.clip(1 / (1 + np.exp(-(w[0] + z[check] @ w[1:]))), 1e-9, 1 - 1e-9)
        loss = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()
        best = min(best, (loss, penalty))
    w = lasso(np.arange(len(y)), best[1], w)
    weights = w[1:] / spread
    kept = [(tuple((names[j], above, cut) for j, above, cut in r), float(v)) for r, v in zip(rules, weights, strict=True) if v]
    return float(w[0] - (weights * fires.mean(axis=0)).sum()), kept


def compile_rules(bias: float, rules: list[tuple[Rule, float]]) -> Column:
    """The probability as a column expression over the statistics."""
    total = F.lit(bias)
    for rule, weight in rules:
        fires = reduce(lambda a, b: a & b, [(F.col(name) > cut) if above else (F.col(name) <= cut) for name, above, cut in rule])
        total = total + F.when(fires, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    The rules are fitted on at most ``sample`` labelled rows (those whose id has
    the smallest hash) that are not held out; ids, languages and sources are
    never inputs. Null and empty texts are scored as empty ones. Without labels
    every score is 0.5; with labels of one class it is near that class. Rows
    repeat as in the input, and other columns are not read. An empty table gives an empty result.
    """
    stats = statistics(F.col("text"))
    rows = materialise(docs.select("doc_id", *[c.alias(n) for n, c in stats.items()]), "statistics")
    known = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    first = rows.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *stats).limit(sample)
    got = first.select(*stats, "quality").collect()
    table = np.array([list(r) for r in got], float).reshape(len(got), len(stats) + 1)
    bias, rules = fit_rules(table[:, :-1], table[:, -1], list(stats))
    p = compile_rules(bias, rules)
    return rows.select("doc_id", held_out().alias("held_out"), p.alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
