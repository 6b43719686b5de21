"""Queries of masks, metrics, thresholds, windows and strata, over scored user-days."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.functions import scalar
from vigilake.operators import drift, features, metrics, policies
from vigilake.plans.frames import SCORED_SQL, rounded, scored
from vigilake.sources import adapters

QUERIES, ORACLE_SQL = {}, {}
REFERENCE = {"alerts_per_day": 20.0, "score_median": 0.25, "precision": 0.05}


def query(sql: str | None = None, start: str = SCORED_SQL):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {start.strip()}\n{sql.strip()}" if start else sql.strip()
        return f

    return keep


def metrics_sql(source: str, by: str = "", alert: str = "alert", label: str = "is_malicious") -> str:
    """The columns of binary_metrics as SQL, by an optional column."""
    own = f"{by}, " if by else ""
    return f"""SELECT {own}n, n_positives, tp, fp, fn, tn, tp + fp AS n_alerts, round(p, 6) AS precision, round(r, 6) AS recall, round(2.0 * tp / greatest(2.0 * tp + fp + fn, 1e-9), 6) AS f1,
round(CASE WHEN z > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt(z) ELSE 0.0 END, 6) AS mcc, round((r + tn / greatest(tn + fp, 1.0)) / 2, 6) AS balanced_accuracy,
round(fp / greatest(fp + tn, 1.0), 6) AS fpr, round(fn / greatest(fn + tp, 1.0), 6) AS fnr, round((tp + fp) / greatest(n, 1.0), 6) AS alert_rate
FROM (SELECT *, tp / greatest(tp + fp, 1.0) AS p, tp / greatest(tp + fn, 1.0) AS r, (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) AS z FROM (
  SELECT {own}count(*) AS n, count(*) FILTER ({label} = 1) AS n_positives, count(*) FILTER ({alert} AND {label} = 1) AS tp, count(*) FILTER ({alert} AND {label} = 0) AS fp,
  count(*) FILTER (NOT {alert} AND {label} = 1) AS fn, count(*) FILTER (NOT {alert} AND {label} = 0) AS tn FROM {source} {"GROUP BY " + by if by else ""}))"""


def best_sql(source: str, score: str = "score", label: str = "is_malicious") -> str:
    """(score, f) of each threshold, by the definition."""
    return f"""SELECT s.t AS t, round(2.0 * count(*) FILTER (b.{score} >= s.t AND b.{label} = 1) / greatest(count(*) FILTER (b.{score} >= s.t) + count(*) FILTER (b.{label} = 1), 1e-9), 12) AS f
FROM (SELECT DISTINCT {score} AS t FROM {source}) s CROSS JOIN {source} b GROUP BY s.t"""


WIN = "win AS (SELECT *, CAST((dense_rank() OVER (ORDER BY day) - 1) // 7 AS INTEGER) AS w FROM base)"
ROC = """pts AS (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, n, pos FROM (SELECT score, count(*) AS n, sum(is_malicious) AS pos FROM base GROUP BY ALL) WINDOW w AS (ORDER BY score DESC))"""
#: Users in thirds by activity are the strata that the reports compare.
FOUND = """bad AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rk FROM base WHERE is_malicious = 1),
det AS (SELECT user_id, min(day) AS onset, count(*) AS n_days, min(day) FILTER (alert) AS first_alert, min(rk) FILTER (alert) AS alert_rank, count(*) FILTER (alert) AS n_detected FROM bad GROUP BY ALL),
det2 AS (SELECT *, CAST(date_diff('day', onset, first_alert) AS INTEGER) AS delay, n_detected > 0 AS detected, n_detected = n_days AS fully_detected, coalesce(date_diff('day', onset, first_alert) < 7, false) AS first_week FROM det)"""


@query(metrics_sql("base"))
def metrics_confusion(spark, sf):
    df = scored(spark, sf)
    return rounded(metrics.binary_metrics(df, F.col("alert"), F.col("is_malicious")))


@query(metrics_sql("base", "split"))
def metrics_by_split(spark, sf):
    df = scored(spark, sf)
    return rounded(metrics.binary_metrics(df, F.col("alert"), F.col("is_malicious"), ["split"]))


@query("""SELECT (SELECT count(*) FROM base) AS n, (SELECT CAST(sum(is_malicious) AS BIGINT) FROM base) AS n_positives,
round((SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) FROM base a CROSS JOIN base b WHERE a.is_malicious = 1 AND b.is_malicious = 0), 6) AS roc_auc,
round((SELECT sum(pos * tp / (tp + fp)) / sum(pos) FROM (SELECT pos::DOUBLE AS pos, tp::DOUBLE AS tp, fp::DOUBLE AS fp FROM pts)), 6) AS pr_auc""", SCORED_SQL + ",\n" + ROC)
def metrics_ranking(spark, sf):
    return rounded(metrics.ranking_metrics(scored(spark, sf), label="is_malicious"))


@query("""SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positives, round((SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*) FROM j a CROSS JOIN j b WHERE a.y = 1 AND b.y = 0), 6) AS roc_auc,
round((SELECT sum(pos::DOUBLE * tp / upto) / sum(pos) FROM (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS upto FROM (SELECT s, count(*) AS n, sum(y) AS pos FROM j GROUP BY ALL))), 6) AS pr_auc FROM j""",
       "j AS (SELECT d.n_chars::DOUBLE AS s, l.toxic AS y FROM documents d JOIN labels l USING (doc_id))")
def documents_ranking(spark, sf):
    rows = adapters.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(adapters.table(spark, sf, "labels"), "doc_id")
    return rounded(metrics.ranking_metrics(rows, label="toxic"))


@query("""SELECT CAST(least(k, (SELECT count(*) FROM base)) AS INTEGER) AS k, CAST(count(*) FILTER (rn <= k AND is_malicious = 1) AS BIGINT) AS tp, round(count(*) FILTER (rn <= k AND is_malicious = 1) / least(k, (SELECT count(*) FROM base))::DOUBLE, 6) AS precision,
round(count(*) FILTER (rn <= k AND is_malicious = 1) / (SELECT sum(is_malicious) FROM base)::DOUBLE, 6) AS recall
FROM (SELECT *, row_number() OVER (ORDER BY score DESC, user_id, day) AS rn FROM base) CROSS JOIN (SELECT unnest([10, 30, 50, 100]) AS k) GROUP BY k""")
def metrics_topk(spark, sf):
    return rounded(metrics.top_k_metrics(scored(spark, sf)))


@query(f"SELECT t AS threshold, f AS f1 FROM ({best_sql('base')}) ORDER BY f DESC, t LIMIT 1")
def best_f1(spark, sf):
    return metrics.best_f1_threshold(scored(spark, sf), label="is_malicious")


@query("""SELECT coalesce((SELECT max(threshold) FROM pts WHERE CASE WHEN pos > 0 THEN tp::DOUBLE / (tp + fp - n + pos) ELSE tp::DOUBLE / (tp + fp - n + 1) END >= 0.5),
  (SELECT max(score) FROM base WHERE is_malicious = 1), (SELECT max(score) FROM base)) AS threshold""", SCORED_SQL + ",\n" + ROC)
def precision_threshold(spark, sf):
    return metrics.threshold_at_precision(scored(spark, sf), 0.5, label="is_malicious")


@query("""SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(fp::DOUBLE / (SELECT count(*) - sum(is_malicious) FROM base), 6) AS fpr,
round(tp::DOUBLE / (SELECT sum(is_malicious) FROM base), 6) AS recall, round(tp::DOUBLE / (tp + fp), 6) AS precision FROM pts""", SCORED_SQL + ",\n" + ROC)
def roc_pr_curves(spark, sf):
    return rounded(metrics.curves(scored(spark, sf), label="is_malicious"))


@query("""SELECT s.scenario, coalesce(n, 0) AS n_positives, coalesce(d, 0) AS n_detected, round(d::DOUBLE / n, 6) AS recall FROM (SELECT DISTINCT scenario FROM incidents) s LEFT JOIN
(SELECT scenario, count(*) AS n, count(*) FILTER (alert) AS d FROM base JOIN incidents USING (user_id) WHERE is_malicious = 1 GROUP BY ALL) x USING (scenario)""")
def scenario_recall(spark, sf):
    return rounded(metrics.scenario_recall(scored(spark, sf), adapters.incidents(adapters.events(spark, sf)), F.col("alert")))


Z = 1.6448536269514722
@query(f"""SELECT n_users, n_detected, n_full, n_missed, mean_delay, share, round(greatest((p + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) - {Z} * sqrt(p * (1 - p) / n + {Z * Z} / (4 * n * n)) / (1 + {Z * Z} / n), 0.0), 6) AS ci_low,
round(least((p + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) + {Z} * sqrt(p * (1 - p) / n + {Z * Z} / (4 * n * n)) / (1 + {Z * Z} / n), 1.0), 6) AS ci_high
FROM (SELECT count(*) AS n_users, count(*) FILTER (detected) AS n_detected, count(*) FILTER (fully_detected) AS n_full, count(*) FILTER (NOT detected) AS n_missed, round(avg(delay), 6) AS mean_delay,
  round(count(*) FILTER (detected)::DOUBLE / count(*), 6) AS share, count(*)::DOUBLE AS n, count(*) FILTER (detected)::DOUBLE / count(*) AS p FROM det2)""", SCORED_SQL + ",\n" + FOUND)
def detection_coverage(spark, sf):
    return rounded(metrics.coverage(metrics.detection(scored(spark, sf))))


@query("SELECT user_id, onset, n_days, first_alert, CAST(alert_rank AS INTEGER) AS alert_rank, n_detected, delay, detected, fully_detected, first_week FROM det2", SCORED_SQL + ",\n" + FOUND)
def detection_by_user(spark, sf):
    return metrics.detection(scored(spark, sf))


@query("""SELECT 'scenario' AS field, CAST(scenario AS VARCHAR) AS value, count(*) AS n_users, count(*) FILTER (detected) AS n_detected FROM det2 JOIN incidents USING (user_id) GROUP BY scenario
UNION ALL SELECT 'first_week', CAST(first_week AS VARCHAR), count(*), count(*) FILTER (detected) FROM det2 GROUP BY first_week
UNION ALL SELECT 'length', CASE WHEN n_days <= 2 THEN 'short' WHEN n_days >= 4 THEN 'long' ELSE 'middle' END AS l, count(*), count(*) FILTER (detected) FROM det2 GROUP BY l
UNION ALL SELECT 'department', CAST(user_id % 5 AS VARCHAR) AS l, count(*), count(*) FILTER (detected) FROM det2 GROUP BY l""", SCORED_SQL + ",\n" + FOUND)
def strata_grouping_sets(spark, sf):
    found = metrics.detection(scored(spark, sf)).join(adapters.incidents(adapters.events(spark, sf)).select("user_id", "scenario"), "user_id")
    found = found.withColumns({"length": scalar.length_class(F.col("n_days"), 2, 4), "department": F.col("user_id") % 5})
    return metrics.coverage_by_strata(found, ["scenario", "first_week", "length", "department"])


@query("""SELECT b.bucket, coalesce(n_users, 0) AS n_users, coalesce(n_detected, 0) AS n_detected, CAST(coalesce(missed, 0) AS BIGINT) AS missed_days, CAST(coalesce(alerts, 0) AS BIGINT) AS n_alerts
FROM (SELECT unnest(['1', '2-5', '6-12', '13-44', '45-100', '101+']) AS bucket) b LEFT JOIN (SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 12 THEN '6-12' WHEN n <= 44 THEN '13-44' WHEN n <= 100 THEN '45-100' ELSE '101+' END AS bucket,
  count(*) AS n_users, count(*) FILTER (hit > 0) AS n_detected, sum(n - hit) AS missed, sum(a) AS alerts FROM (
  SELECT user_id, sum(is_malicious) AS n, count(*) FILTER (alert AND is_malicious = 1) AS hit, count(*) FILTER (alert) AS a FROM base GROUP BY ALL) WHERE n > 0 GROUP BY ALL) x USING (bucket)""")
def activity_strata(spark, sf):
    return drift.activity_strata(scored(spark, sf))


@query("""SELECT round((SELECT 2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*)::DOUBLE FROM (SELECT n::DOUBLE AS n, row_number() OVER (ORDER BY n) AS i FROM (SELECT count(*) FILTER (alert) AS n FROM base GROUP BY user_id))), 6) AS gini""")
def gini_of_alerts(spark, sf):
    return rounded(metrics.gini(scored(spark, sf).groupBy("user_id").agg(F.count_if("alert").alias("n")), "n"))


@query("""SELECT count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_alerts, round(avg(n), 6) AS mean, round(median(n), 6) AS median, max(n) AS most,
round(sum(n) FILTER (i <= ceil(0.01 * m))::DOUBLE / sum(n), 6) AS top_1pct_share, round(sum(n) FILTER (i <= ceil(0.05 * m))::DOUBLE / sum(n), 6) AS top_5pct_share, round(sum(n) FILTER (i <= ceil(0.1 * m))::DOUBLE / sum(n), 6) AS top_10pct_share,
round(2 * sum((m + 1 - i) * n::DOUBLE) / (count(*) * sum(n)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini
FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS i, count(*) OVER () AS m FROM (SELECT user_id, count(*) AS n FROM base WHERE alert GROUP BY ALL))""")
def user_concentration(spark, sf):
    return rounded(policies.user_concentration(scored(spark, sf)))


@query("""SELECT user_id, count(*) AS n_days, max(score) AS max_score, round(sum(CAST(score AS DECIMAL(18, 9)))::DOUBLE / count(*), 6) AS mean_score, count(*) FILTER (score >= 0.5) AS high_days, count(*) FILTER (alert) AS n_alerts, max(is_malicious) AS label,
round(list_sum(list(CAST(score AS DECIMAL(18, 9)) ORDER BY score DESC)[1:3])::DOUBLE / least(count(*), 3), 6) AS top3_mean FROM base GROUP BY user_id""")
def user_diagnostics(spark, sf):
    return rounded(metrics.user_diagnostics(scored(spark, sf)))


@query("SELECT count(*) AS n_distinct, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c) FILTER (c > 1) AS BIGINT) AS n_tied, round(sum(c) FILTER (c > 1)::DOUBLE / sum(c), 6) AS tied_share, sum(c) FILTER (c > 1)::DOUBLE / sum(c) > 0.01 AS caution FROM (SELECT count(*) AS c FROM base GROUP BY score)")
def tie_audit(spark, sf):
    return rounded(metrics.tie_audit(scored(spark, sf)))


@query("""SELECT w::DOUBLE AS width, count(*) FILTER (is_malicious = 1 AND score < 0.5 AND score >= 0.5 - w::DOUBLE) AS n_near_misses, count(*) FILTER (is_malicious = 0 AND score >= 0.5 AND score < 0.5 + w::DOUBLE) AS n_near_false
FROM base CROSS JOIN (SELECT unnest([0.05, 0.1, 0.2]) AS w) GROUP BY w""")
def near_threshold(spark, sf):
    return metrics.near_threshold(scored(spark, sf), 0.5)


@query("SELECT user_id, day, score FROM base WHERE alert")
def mask_threshold(spark, sf):
    return policies.threshold_mask(scored(spark, sf), 0.5).filter("alert").select("user_id", "day", "score")


@query("SELECT user_id, day, score FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, user_id) AS r FROM base) WHERE r <= 5")
def mask_daily_topk(spark, sf):
    return policies.daily_top_k(scored(spark, sf), 5).filter("alert").select("user_id", "day", "score")


@query("SELECT user_id, day, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, user_id, day) AS r, count(*) OVER () AS n FROM base) WHERE r <= ceil(0.01 * n)")
def mask_percentile(spark, sf):
    return policies.top_share(scored(spark, sf), 0.01).filter("alert").select("user_id", "day", "score")


CANDIDATES = policies.candidates(0.5, 0.6)
_HITS = {
    "threshold": "score >= {p}", "capacity": "row_number() OVER (PARTITION BY day ORDER BY score DESC, user_id) <= {p}", "percentile": "row_number() OVER (ORDER BY score DESC, user_id, day) <= ceil({p}::DOUBLE * (SELECT count(*) FROM base))",
}
CAND = "cand AS (" + "\nUNION ALL ".join(f"SELECT '{n}' AS candidate, '{k}' AS kind, user_id, day, is_malicious, {_HITS[k].format(p=p)} AS hit FROM base" for n, (k, p) in CANDIDATES.items()) + ")"


@query(metrics_sql("cand", "candidate, kind", "hit"), SCORED_SQL + ",\n" + CAND)
def policy_candidates(spark, sf):
    return rounded(policies.evaluate(scored(spark, sf), CANDIDATES))


@query(f"""SELECT candidate FROM (SELECT candidate, f1, alert_rate FROM ({metrics_sql("cand", "candidate, kind", "hit")})) m WHERE alert_rate > 0 AND candidate NOT IN (
  SELECT w.candidate FROM (SELECT candidate, w, avg(hit::INT) AS rate, count(*) FILTER (hit AND is_malicious = 1) AS tp FROM cand JOIN (SELECT day, ntile(4) OVER (ORDER BY day) AS w FROM days) USING (day) GROUP BY ALL) w
  JOIN (SELECT candidate, avg(hit::INT) AS whole FROM cand GROUP BY ALL) a USING (candidate) WHERE rate < 0.5 * whole OR rate > 2 * whole OR tp = 0) ORDER BY f1 DESC, alert_rate, candidate DESC LIMIT 1""", SCORED_SQL + ",\n" + CAND)
def policy_selected(spark, sf):
    df = scored(spark, sf)
    overall = policies.evaluate(df, CANDIDATES)
    parts = policies.evaluate(policies.day_windows(df, n=4), CANDIDATES, by=["window"])
    return policies.select_policy(policies.screens(overall, parts)).select("candidate")




@query(f"""SELECT m.*, score_min, score_max, score_p50, score_p90, score_p99 FROM (SELECT w AS window, * EXCLUDE (w) FROM ({metrics_sql("win", "w")})) m JOIN (
SELECT w AS window, min(score) AS score_min, max(score) AS score_max, round(quantile_cont(score, 0.5), 6) AS score_p50, round(quantile_cont(score, 0.9), 6) AS score_p90, round(quantile_cont(score, 0.99), 6) AS score_p99 FROM win GROUP BY w) q ON q."window" = m."window\"""", SCORED_SQL + ",\n" + WIN)
def window_policy_metrics(spark, sf):
    return rounded(policies.window_policy_metrics(policies.day_windows(scored(spark, sf), days=7)))


@query("""SELECT w."window", coalesce(x.t, 0.9186015432508062) AS threshold FROM (SELECT DISTINCT w AS "window" FROM win) w LEFT JOIN (
  SELECT cur, t FROM (SELECT cur, t, f, row_number() OVER (PARTITION BY cur ORDER BY f DESC, t) AS rn FROM (
    SELECT s.cur, s.t, round(2.0 * count(*) FILTER (b.score >= s.t AND b.is_malicious = 1) / greatest(count(*) FILTER (b.score >= s.t) + count(*) FILTER (b.is_malicious = 1), 1e-9), 12) AS f
    FROM (SELECT DISTINCT a.w AS cur, p.score AS t FROM (SELECT DISTINCT w FROM win) a JOIN win p ON p.w < a.w) s JOIN win b ON b.w < s.cur GROUP BY ALL)) WHERE rn = 1 AND f > 0) x ON x.cur = w."window\"""", SCORED_SQL + ",\n" + WIN)
def rolling_threshold(spark, sf):
    return policies.rolling_thresholds(scored(spark, sf), 7)


@query("SELECT count(*) AS n_chunks, count(*) FILTER (a = 0) AS n_zero FROM (SELECT w, count(*) FILTER (score >= 0.8) AS a FROM win GROUP BY w)", SCORED_SQL + ",\n" + WIN)
def zero_alert_chunks(spark, sf):
    return policies.zero_alert_chunks(policies.threshold_mask(scored(spark, sf), 0.8), 7)


@query("""SELECT w AS window, b.bound, CASE b.bound
 WHEN 'B1' THEN CASE WHEN a >= 1 THEN 'pass' ELSE 'fail' END
 WHEN 'B2' THEN CASE WHEN apd BETWEEN 10 AND 40 THEN 'pass' WHEN apd BETWEEN 9 AND 44 THEN 'caution' ELSE 'fail' END
 WHEN 'B3' THEN CASE WHEN med BETWEEN 0.125 AND 0.5 THEN 'pass' WHEN med BETWEEN 0.1125 AND 0.55 THEN 'caution' ELSE 'fail' END
 WHEN 'B4' THEN CASE WHEN p = 0 OR tp::DOUBLE / greatest(p, 1) >= 0.25 THEN 'pass' WHEN tp::DOUBLE / p >= 0.225 THEN 'caution' ELSE 'fail' END
 WHEN 'B5' THEN CASE WHEN a = 0 OR tp::DOUBLE / greatest(a, 1) >= 0.025 THEN 'pass' WHEN tp::DOUBLE / a >= 0.0225 THEN 'caution' ELSE 'fail' END
 ELSE CASE WHEN p > 0 AND tp = 0 THEN 'fail' ELSE 'pass' END END AS status
FROM (SELECT w, count(*) FILTER (alert) AS a, count(*) FILTER (alert)::DOUBLE / count(DISTINCT day) AS apd, quantile_cont(score, 0.5) AS med, sum(is_malicious) AS p, count(*) FILTER (alert AND is_malicious = 1) AS tp FROM win GROUP BY w)
CROSS JOIN (SELECT unnest(['B1', 'B2', 'B3', 'B4', 'B5', 'B6']) AS bound) b""", SCORED_SQL + ",\n" + WIN)
def bounds_check(spark, sf):
    df = policies.day_windows(scored(spark, sf), days=7)
    stats = metrics.binary_metrics(df, F.col("alert"), F.col("is_malicious"), ["window"]).join(df.groupBy("window").agg(F.countDistinct("day").alias("d"), F.percentile("score", 0.5).alias("score_median")), "window")
    return policies.bounds(stats.withColumn("alerts_per_day", F.col("n_alerts") / F.col("d")), REFERENCE)


@query("""SELECT round(avg(u), 6) AS users_per_day, round(avg(a), 6) AS alerts_per_day, max(a) AS most_alerts, f::DOUBLE AS factor, round(avg(a) * f::DOUBLE, 6) AS projected_alerts_per_day,
(SELECT round(max(n) / sum(n)::DOUBLE, 6) FROM (SELECT count(*) AS n FROM base WHERE alert GROUP BY user_id)) AS top_user_share,
(SELECT round(sum(n) FILTER (i <= ceil(0.01 * m))::DOUBLE / sum(n), 6) FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS i, count(*) OVER () AS m FROM (SELECT count(*) AS n FROM base WHERE alert GROUP BY user_id))) AS top_1pct_share
FROM (SELECT day, count(DISTINCT user_id) AS u, count(*) FILTER (alert) AS a FROM base GROUP BY day) CROSS JOIN (SELECT unnest([1.0, 2.0, 5.0]) AS f) GROUP BY f""")
def capacity_projection(spark, sf):
    return rounded(policies.capacity_projection(scored(spark, sf)))


@query("""a AS MATERIALIZED (SELECT DISTINCT user_id, day FROM base WHERE alert),
r AS (SELECT user_id, min(day) AS day FROM a GROUP BY ALL UNION ALL SELECT r.user_id, (SELECT min(a.day) FROM a WHERE a.user_id = r.user_id AND a.day >= r.day + 3) FROM r WHERE EXISTS (SELECT 1 FROM a WHERE a.user_id = r.user_id AND a.day >= r.day + 3))
SELECT user_id, day FROM r""".replace("a AS", ", a AS", 1), "RECURSIVE " + SCORED_SQL.strip())
def dedup_alerts(spark, sf):
    return policies.suppress(scored(spark, sf), 3).filter("emitted").select("user_id", "day")


@query(f"""SELECT 'P0' AS policy, m.*, u.*, (SELECT round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*)::DOUBLE, 6) FROM (SELECT n::DOUBLE AS n, row_number() OVER (ORDER BY n) AS i FROM (SELECT count(*) FILTER (alert) AS n FROM base GROUP BY user_id))) AS gini,
(SELECT count(*) FILTER (a = 0) FROM (SELECT w, count(*) FILTER (alert) AS a FROM win GROUP BY w)) AS n_zero FROM ({metrics_sql("base")}) m CROSS JOIN (SELECT count(*) FILTER (n > 0) AS n_users_alerted, max(n) AS most_by_user, round(avg(n), 6) AS mean_by_user, round(sum(n)::DOUBLE / greatest(count(*) FILTER (n > 0), 1), 6) AS mean_by_alerted
FROM (SELECT count(*) FILTER (alert) AS n FROM base GROUP BY user_id)) u""", SCORED_SQL + ",\n" + WIN)
def policy_metrics_base(spark, sf):
    return rounded(policies.policy_metrics(scored(spark, sf)).select(F.lit("P0").alias("policy"), "*"))


@query()
def operational_policy(spark, sf):
    df = scored(spark, sf)
    base = policies.policy_metrics(df).withColumn("policy", F.lit("P0"))
    for w in (1, 3, 7):
        own = policies.suppress(df, w).withColumn("alert", F.col("emitted"))
        base = base.unionByName(policies.policy_metrics(own).withColumn("policy", F.lit(f"DEDUP_{w}")))
    return rounded(policies.select_operational(base))


@query("SELECT user_id, day, split FROM base WHERE split = 'test'")
def split_test_rows(spark, sf):
    parts = features.split_table(scored(spark, sf).drop("split"), "2024-01-18", "2024-01-24")
    return parts["test"].select("user_id", "day", F.lit("test").alias("split"))
