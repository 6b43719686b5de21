"""Queries of calibration, drift, components, decisions, resampling and models, over scored user-days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from vigilake.operators import calibration, components, decision, drift, learned, metrics, policies, resampling, treeshap
from vigilake.operators.features import COUNTS
from vigilake.plans.frames import SCORED_SQL, rounded, scored
from vigilake.plans.metric_queries import WIN
from vigilake.sources import adapters

QUERIES, ORACLE_SQL = {}, {}
MODEL = [*COUNTS, *decision.GRAPH]
TRUST = ["device_consistency_score", "rare_device_usage_count", "file_type_consistency_score", "rare_file_type_access_count"]


def query(sql: str | None = None, start: str = SCORED_SQL):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {start.strip()}\n{sql.strip()}" if start else sql.strip()
        return f

    return keep


def parts(spark, sf):
    df = scored(spark, sf)
    return {n: df.filter(F.col("split") == n) for n in ("train", "calibration", "test")}


def phi_sql(x: str) -> str:
    """The normal distribution function by its odd power series."""
    series = reduce(lambda s, k: f"(1.0 + ({x}) * ({x}) / {2 * k + 1}.0 * {s})", range(40, 0, -1), "1.0")
    return f"(0.5 + exp(-({x}) * ({x}) / 2.0) / sqrt(2 * pi()) * ({x}) * {series})"


CONF = """cal AS (SELECT score AS s, is_malicious AS y FROM base WHERE split = 'calibration'),
tst AS (SELECT user_id, day, score, is_malicious, alert, (SELECT count(*) FROM cal WHERE y = 1 AND s <= score) AS c1, (SELECT count(*) FROM cal WHERE y = 0 AND s >= score) AS c0 FROM base WHERE split = 'test'),
pv AS (SELECT *, (c1 + 1) / ((SELECT count(*) FROM cal WHERE y = 1) + 1)::DOUBLE AS p1, (c0 + 1) / ((SELECT count(*) FROM cal WHERE y = 0) + 1)::DOUBLE AS p0 FROM tst)"""
CATEGORY = "CASE WHEN p1 > {a} AND p0 > {a} THEN '{{0,1}}' WHEN p1 > {a} THEN '{{1}}' WHEN p0 > {a} THEN '{{0}}' ELSE '{{}}' END"


@query("SELECT user_id, day, round(p1, 6) AS p1, round(p0, 6) AS p0 FROM pv", SCORED_SQL + ",\n" + CONF)
def conformal_pvalues(spark, sf):
    p = parts(spark, sf)
    return rounded(calibration.conformal_p(p["calibration"], p["test"]).select("user_id", "day", "p1", "p0"))


@query(f"SELECT user_id, day, {CATEGORY.format(a=0.05)} AS category, CASE {CATEGORY.format(a=0.05)} WHEN '{{0,1}}' THEN 0.9 WHEN '{{}}' THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence FROM pv", SCORED_SQL + ",\n" + CONF)
def conformal_sets(spark, sf):
    p = parts(spark, sf)
    df = calibration.conformal_p(p["calibration"], p["test"]).withColumn("category", calibration.set_category(F.col("p1"), F.col("p0"), 0.05))
    return rounded(df.select("user_id", "day", "category", calibration.confidence(F.col("category"), 0.05).alias("confidence")))


@query(" UNION ALL ".join(f"""SELECT {a}::DOUBLE AS alpha, count(*) AS n, round(avg((CASE WHEN is_malicious = 1 THEN p1 > {a} ELSE p0 > {a} END)::INT), 6) AS coverage, round(avg((p1 > {a})::INT) FILTER (is_malicious = 1), 6) AS coverage_pos,
round(avg((p0 > {a})::INT) FILTER (is_malicious = 0), 6) AS coverage_neg, count(*) FILTER ((p1 > {a}) <> (p0 > {a})) AS n_single, count(*) FILTER (p1 > {a} AND p0 > {a}) AS n_both, count(*) FILTER (p1 <= {a} AND p0 <= {a}) AS n_empty FROM pv""" for a in calibration.ALPHAS), SCORED_SQL + ",\n" + CONF)
def conformal_coverage(spark, sf):
    p = parts(spark, sf)
    return rounded(calibration.coverage(calibration.conformal_p(p["calibration"], p["test"])))


@query(f"SELECT alert, category, count(*) AS n, CAST(sum(is_malicious) AS BIGINT) AS n_pos, round(avg(is_malicious), 6) AS precision FROM (SELECT *, {CATEGORY.format(a=0.05)} AS category FROM pv) GROUP BY CUBE (alert, category)", SCORED_SQL + ",\n" + CONF)
def alert_crosstab(spark, sf):
    p = parts(spark, sf)
    return rounded(calibration.crosstab(calibration.conformal_p(p["calibration"], p["test"])))


@query("""SELECT k1, CASE WHEN k1 = 0 THEN '-Infinity'::DOUBLE ELSE (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) AS r FROM cal WHERE y = 1) WHERE r = k1) END AS t1,
k0, CASE WHEN k0 = 0 THEN 'Infinity'::DOUBLE ELSE (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s DESC) AS r FROM cal WHERE y = 0) WHERE r = k0) END AS t0
FROM (SELECT CAST(floor(0.05 * (count(*) FILTER (y = 1) + 1)) AS BIGINT) AS k1, CAST(floor(0.05 * (count(*) FILTER (y = 0) + 1)) AS BIGINT) AS k0 FROM cal)""", SCORED_SQL + ",\n" + CONF)
def inclusion_thresholds(spark, sf):
    return calibration.inclusion_thresholds(parts(spark, sf)["calibration"], 0.05)


@query("SELECT round(avg((score - is_malicious) * (score - is_malicious)), 6) AS brier FROM base")
def brier(spark, sf):
    return rounded(calibration.brier(scored(spark, sf), "score", "is_malicious"))


RELIABILITY = "rel AS (SELECT bin, count(*) AS n, avg(score) AS mean_p, avg(is_malicious) AS rate FROM (SELECT *, CAST(ntile(10) OVER (ORDER BY score, user_id, day) AS INTEGER) AS bin FROM base) GROUP BY bin)"


@query("SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM rel", SCORED_SQL + ",\n" + RELIABILITY)
def ece_reliability(spark, sf):
    return rounded(calibration.reliability(scored(spark, sf), 10, "score", "is_malicious"))


@query("SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece FROM rel", SCORED_SQL + ",\n" + RELIABILITY)
def ece(spark, sf):
    return rounded(calibration.ece(calibration.reliability(scored(spark, sf), 10, "score", "is_malicious")))


@query("""SELECT CAST(b AS INTEGER) AS bin, min(score) AS lo, max(score) AS hi, count(*) AS n, CAST(sum(is_malicious) AS BIGINT) AS pos FROM (
SELECT base.*, (SELECT count(*) FROM (SELECT DISTINCT unnest(q) AS c) WHERE c < base.score) AS b FROM base CROSS JOIN (SELECT quantile_cont(score, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS q FROM base)) GROUP BY b""")
def quantile_bins(spark, sf):
    return rounded(calibration.quantile_bins(scored(spark, sf), 20, "score", "is_malicious"))


@query("""SELECT user_id, day, round(greatest(0.0, least(1.0, (((SELECT count(*) FROM base t WHERE t.split = 'train' AND t.score < b.score) + (SELECT count(*) FROM base t WHERE t.split = 'train' AND t.score <= b.score)) / 2.0 - 0.5)
 / (SELECT count(*) FROM base WHERE split = 'train'))), 6) AS p FROM base b WHERE split = 'test'""")
def ecdf_map(spark, sf):
    p = parts(spark, sf)
    return rounded(drift.ecdf(p["train"], p["test"], "score").select("user_id", "day", "p"))


@query("""SELECT round(ks, 6) AS ks, n_a, n_b, round(CASE WHEN lam < 0.3 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam))))) END, 6) AS p_value
FROM (SELECT *, (sqrt(n_a * n_b / (n_a + n_b)::DOUBLE) + 0.12 + 0.11 / sqrt(n_a * n_b / (n_a + n_b)::DOUBLE)) * ks AS lam FROM (
SELECT max(abs(a / na - b / nb)) AS ks, max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b FROM (SELECT score, sum(count(*) FILTER (split = 'train')) OVER (ORDER BY score)::DOUBLE AS a, sum(count(*) FILTER (split = 'test')) OVER (ORDER BY score)::DOUBLE AS b FROM base GROUP BY score)
CROSS JOIN (SELECT count(*) FILTER (split = 'train')::DOUBLE AS na, count(*) FILTER (split = 'test')::DOUBLE AS nb FROM base)))""")
def ks_stat(spark, sf):
    return rounded(drift.ks(scored(spark, sf), "score", "split", "train", "test"))


@query("""SELECT round(sum((o - e) * ln(o / e)), 6) AS psi FROM (SELECT greatest(coalesce(r, 0) / (SELECT count(*) FROM base WHERE split = 'train')::DOUBLE, 1e-6) AS e, greatest(coalesce(a, 0) / (SELECT count(*) FROM base WHERE split = 'test')::DOUBLE, 1e-6) AS o
FROM (SELECT unnest(range(1, greatest(len(ed) - 1, 1) + 1)) AS b FROM edges) LEFT JOIN (
  SELECT least((SELECT count(*) FROM (SELECT unnest(ed) AS x) WHERE x <= score), len(ed) - 1) AS b, count(*) FILTER (split = 'train') AS r, count(*) FILTER (split = 'test') AS a
  FROM base CROSS JOIN edges WHERE split IN ('train', 'test') AND score BETWEEN ed[1] AND ed[-1] GROUP BY ALL) USING (b))""",
       SCORED_SQL + ",\nedges AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS ed FROM base WHERE split = 'train')")
def psi(spark, sf):
    return rounded(drift.psi(scored(spark, sf), "score", "split", "train", "test"))


@query("""SELECT round((avg(score) FILTER (split = 'train') - avg(score) FILTER (split = 'test')) / sqrt(((count(*) FILTER (split = 'train') - 1) * var_samp(score) FILTER (split = 'train') + (count(*) FILTER (split = 'test') - 1) * var_samp(score) FILTER (split = 'test'))
 / (count(*) FILTER (split IN ('train', 'test')) - 2)), 6) AS cohen_d FROM base""")
def cohen_d(spark, sf):
    return rounded(drift.cohen_d(scored(spark, sf), "score", "split", "train", "test"))


@query("""SELECT round(corr(ra, rb), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ra, rank() OVER (ORDER BY login_count) + (count(*) OVER (PARTITION BY login_count) - 1) / 2.0 AS rb FROM base)""")
def spearman(spark, sf):
    return rounded(drift.spearman(scored(spark, sf), "score", "login_count"))


@query("SELECT round(corr(score, is_malicious), 6) AS r FROM base")
def point_biserial(spark, sf):
    return rounded(drift.point_biserial(scored(spark, sf), "score", "is_malicious"))


@query("""SELECT CAST(d + 1 AS INTEGER) AS decile, count(*) AS n, CAST(sum(is_malicious) AS BIGINT) AS n_pos, round(avg(is_malicious), 6) AS share FROM (
SELECT base.*, (SELECT count(*) FROM (SELECT unnest(q) AS c) WHERE c < base.score) AS d FROM base CROSS JOIN (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM base)) GROUP BY d""")
def decile_shares(spark, sf):
    return rounded(drift.decile_shares(scored(spark, sf), "score", "is_malicious"))


LONG = "long AS (UNPIVOT (SELECT split, user_id, day, login_count::DOUBLE AS login_count, http_activity_count::DOUBLE AS http_activity_count, device_consistency_score FROM base) ON login_count, http_activity_count, device_consistency_score INTO NAME feature VALUE value)"
SHIFT = ["login_count", "http_activity_count", "device_consistency_score"]


@query("""SELECT feature, split, count(*) AS n, round(max(m), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(median(abs(value - m)), 6) AS mad, round(avg((value = 0)::INT), 6) AS zero_share
FROM long JOIN (SELECT feature, split, median(value) AS m FROM long GROUP BY ALL) USING (feature, split) GROUP BY ALL""", SCORED_SQL + ",\n" + LONG)
def feature_shift(spark, sf):
    return rounded(drift.shift(scored(spark, sf), SHIFT, "split"))


@query("SELECT feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(max(value), 6) AS max, round(stddev_samp(value) / abs(avg(value)), 6) AS cv FROM long GROUP BY feature", SCORED_SQL + ",\n" + LONG)
def feature_summary(spark, sf):
    return rounded(drift.summarise(scored(spark, sf), SHIFT))


def z_sql(col: str, name: str) -> str:
    return f"""{name} AS (SELECT user_id, day, coalesce(CASE WHEN len(h) < 14 THEN 0.0 WHEN list_median(list_transform(h, lambda v: abs(v - list_median(h)))) < 1e-9 THEN 0.0
 ELSE (x - list_median(h)) / (list_median(list_transform(h, lambda v: abs(v - list_median(h)))) + 1e-6) END, 0.0) AS z
 FROM (SELECT user_id, day, {col}::DOUBLE AS x, coalesce(list({col}::DOUBLE) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS h FROM base))"""


@query("SELECT user_id, day, round(z, 6) AS z FROM zz", SCORED_SQL + ",\n" + z_sql("login_count", "zz"))
def expanding_robust_z(spark, sf):
    return rounded(components.robust_z(scored(spark, sf), "login_count").select("user_id", "day", "z"))


@query("SELECT user_id, day, round(z, 6) AS z FROM zz", SCORED_SQL + ",\n" + z_sql("login_count", "zz"))
def expanding_robust_z_grouped(spark, sf):
    return rounded(components.robust_z_grouped(scored(spark, sf).select("user_id", "day", "login_count"), "login_count").select("user_id", "day", "z"))


@query(f"SELECT user_id, day, round(({' + '.join(phi_sql(f'least(abs(z{i}.z), 3.0)') for i in range(len(COUNTS)))}) / {len(COUNTS)}.0, 6) AS r_behavior FROM z0 {' '.join(f'JOIN z{i} USING (user_id, day)' for i in range(1, len(COUNTS)))}",
       SCORED_SQL + "".join(",\n" + z_sql(f, f"z{i}") for i, f in enumerate(COUNTS)))
def behaviour_risk(spark, sf):
    return rounded(components.behaviour_risk(scored(spark, sf), COUNTS).select("user_id", "day", "r_behavior"))


def _mid(f: str) -> str:
    return f"""CASE WHEN (SELECT min({f}) = max({f}) FROM base WHERE split = 'train') THEN 0.5 ELSE greatest(0.0, least(1.0, (((SELECT count(*) FROM base t WHERE t.split = 'train' AND t.{f} < b.{f}) + (SELECT count(*) FROM base t WHERE t.split = 'train' AND t.{f} <= b.{f})) / 2.0 - 0.5) / (SELECT count(*) FROM base WHERE split = 'train'))) END"""


@query(f"SELECT user_id, day, round(({' + '.join(_mid(f) for f in TRUST)}) / 4.0, 6) AS r_trust FROM base b WHERE split = 'test'", SCORED_SQL.replace("sc AS (", "sc AS MATERIALIZED ("))
def trust_risk(spark, sf):
    p = parts(spark, sf)
    return rounded(components.trust_risk(p["train"], p["test"], TRUST).select("user_id", "day", "r_trust"))


@query("SELECT user_id, day, round(0.5 * score + 0.3 * (1 - device_consistency_score) + 0.2 * (1 - file_type_consistency_score), 9) AS risk FROM base")
def weighted_risk(spark, sf):
    df = scored(spark, sf).withColumn("a", 1 - F.col("device_consistency_score")).withColumn("b", 1 - F.col("file_type_consistency_score"))
    return rounded(components.weighted(df, {"score": 0.5, "a": 0.3, "b": 0.2}).select("user_id", "day", "risk"), 9)


@query("""SELECT a / 10.0 AS w_0, b / 10.0 AS w_1, (10 - a - b) / 10.0 AS w_2 FROM (SELECT unnest(range(0, 11))::DOUBLE AS a) CROSS JOIN (SELECT unnest(range(0, 11))::DOUBLE AS b) WHERE a + b <= 10""", "")
def simplex_grid(spark, sf):
    return components.simplex_grid(spark)


@query("""SELECT user_id, day, round(list_sum(list_transform(h, lambda v, i: v * (CASE WHEN i = 1 THEN pow(1.0 / 3, n - 1) ELSE 2.0 / 3 * pow(1.0 / 3, n - i) END))), 9) AS smoothed
FROM (SELECT user_id, day, list(score) OVER w AS h, count(*) OVER w AS n FROM base WINDOW w AS (PARTITION BY user_id ORDER BY day))""")
def ewma_scores(spark, sf):
    return rounded(components.ewma(scored(spark, sf), 1 / 3).select("user_id", "day", "smoothed"), 9)


PEERS = "bp a JOIN bp b ON b.pool = a.pool AND b.user_id <> a.user_id AND b.day < a.day"
CONTEXT = f"""roles AS (SELECT DISTINCT user_id, user_id % 3 AS role, user_id % 2 AS department FROM base),
pools AS (SELECT user_id, CASE WHEN count(*) OVER (PARTITION BY role) > 3 THEN 'r' || role WHEN count(*) OVER (PARTITION BY department) > 3 THEN 'd' || department END AS pool FROM roles),
bp AS MATERIALIZED (SELECT base.*, pool, dayofweek(day) BETWEEN 1 AND 5 AS wk FROM base JOIN pools USING (user_id)),
usable AS MATERIALIZED (SELECT user_id, day, CASE WHEN ns >= 20 THEN 1 ELSE 2 END AS kind FROM (SELECT a.user_id, a.day, count(*) FILTER (b.wk = a.wk) AS ns, count(*) AS na FROM {PEERS} GROUP BY ALL) WHERE na >= 20),
md AS MATERIALIZED (SELECT a.user_id, a.day, any_value(kind) AS kind, {', '.join(f'median(b.{f}) AS m{i}' for i, f in enumerate(MODEL))} FROM {PEERS} JOIN usable u ON u.user_id = a.user_id AND u.day = a.day WHERE kind = 2 OR b.wk = a.wk GROUP BY a.user_id, a.day),
dv AS (SELECT a.user_id, a.day, {', '.join(f'CASE WHEN median(abs(b.{f} - m{i})) < 1e-9 THEN 0.0 ELSE least(abs(any_value(a.{f}) - any_value(m{i})) / (median(abs(b.{f} - m{i})) + 1e-6), 3.0) END AS z{i}' for i, f in enumerate(MODEL))}
  FROM {PEERS} JOIN md u ON u.user_id = a.user_id AND u.day = a.day WHERE kind = 2 OR b.wk = a.wk GROUP BY a.user_id, a.day)"""


@query(f"SELECT user_id, day, round(CASE WHEN z0 IS NULL THEN 0.5 ELSE ({' + '.join(phi_sql(f'z{i}') for i in range(len(MODEL)))}) / {len(MODEL)}.0 END, 6) AS r_context FROM base LEFT JOIN dv USING (user_id, day)", SCORED_SQL.replace("sc AS (", "sc AS MATERIALIZED (") + ",\n" + CONTEXT)
def context_risk(spark, sf):
    df = scored(spark, sf).select("user_id", "day", *MODEL)
    roles = df.select("user_id").distinct().select("user_id", (F.col("user_id") % 3).alias("role"), (F.col("user_id") % 2).alias("department"))
    return rounded(components.context_risk(df, components.peers(roles, 3), MODEL).select("user_id", "day", "r_context"))


@query("""SELECT component, CAST(bin AS INTEGER) AS bin, round(greatest(-5.0, least(5.0, ln((pos + 1) / (sum(pos) OVER (PARTITION BY component) + 10)) - ln((neg + 1) / (sum(neg) OVER (PARTITION BY component) + 10)))), 6) AS llr
FROM (SELECT component, least(floor(v * 10), 9) AS bin, sum(is_malicious)::DOUBLE AS pos, sum(1 - is_malicious)::DOUBLE AS neg FROM (SELECT 'score' AS component, score AS v, is_malicious FROM base WHERE split = 'train' UNION ALL SELECT 'device_consistency_score', device_consistency_score, is_malicious FROM base WHERE split = 'train') GROUP BY ALL)""")
def binned_ratios(spark, sf):
    return rounded(components.fit_binned_ratios(parts(spark, sf)["train"], ["score", "device_consistency_score"]))


CDF_OF = ["rare_device_usage_count", "rare_file_type_access_count", "after_hours_login_count", "unusual_access_count", "sensitive_file_access_count"]
GRIDS = f"gr AS MATERIALIZED (SELECT {', '.join(f'quantile_cont({f}, [{", ".join(str(i / 1000) for i in range(1001))}]) AS g{j}' for j, f in enumerate(CDF_OF))} FROM base WHERE split = 'train')"


def _cdf(j: int) -> str:
    below = f"len(list_filter(g{j}, lambda v: v <= {CDF_OF[j]}))"
    return f"CASE WHEN {below} = 0 THEN 0.0 WHEN {below} > 1000 THEN 1.0 ELSE ({below} - 1 + ({CDF_OF[j]} - g{j}[{below}]) / (g{j}[{below} + 1] - g{j}[{below}])) / 1000.0 END"


@query(f"""SELECT user_id, day, score AS c_ml, round((1 - device_consistency_score + 1 - file_type_consistency_score + {_cdf(0)} + {_cdf(1)}) / 4, 6) AS c_trust, round(({_cdf(2)} + {_cdf(3)} + {_cdf(4)}) / 3, 6) AS c_behavior
FROM base CROSS JOIN gr WHERE split = 'test'""", SCORED_SQL.replace("sc AS (", "sc AS MATERIALIZED (") + ",\n" + GRIDS)
def risk_components_v1(spark, sf):
    p = parts(spark, sf)
    return rounded(components.risk_components(p["train"], p["test"]).select("user_id", "day", "c_ml", "c_trust", "c_behavior"))


@query("""SELECT component, n_null::BIGINT AS n_null, n_outside::BIGINT AS n_outside FROM (SELECT 'score' AS component, count(*) FILTER (score IS NULL) AS n_null, count(*) FILTER (score < 0 OR score > 1) AS n_outside FROM base
UNION ALL SELECT 'login_count', count(*) FILTER (login_count IS NULL), count(*) FILTER (login_count > 1) FROM base)""")
def component_sanity(spark, sf):
    return components.sanity(scored(spark, sf), ["score", "login_count"])


LEVEL = "CASE WHEN score >= 0.6 THEN 'ALERT' WHEN score >= 0.55 THEN 'BORDERLINE' WHEN score >= 0.4 THEN 'MONITOR' ELSE 'NON-ALERT' END"
FLAGS = """list_filter([CASE WHEN rare_device_usage_count > 0 THEN 'new_device_count=' || rare_device_usage_count END, CASE WHEN rare_file_type_access_count > 0 THEN 'new_file_type_count=' || rare_file_type_access_count END,
CASE WHEN device_consistency_score < 0.5 THEN 'low_device_consistency' END, CASE WHEN file_type_consistency_score < 0.5 THEN 'low_file_type_consistency' END], lambda x: x IS NOT NULL)"""


@query(f"""SELECT user_id, day, score AS ml_risk, l AS risk_level, CASE c WHEN '{{0,1}}' THEN 0.9 WHEN '{{}}' THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence, c AS conformal_set, round(p1, 6) AS p1, round(p0, 6) AS p0, l IN ('ALERT', 'BORDERLINE') AS alert_flag,
CASE l WHEN 'ALERT' THEN 'escalate_to_incident_response' WHEN 'BORDERLINE' THEN 'queue_for_analyst_review' WHEN 'MONITOR' THEN 'add_to_watchlist' ELSE 'no_action_required' END AS recommended_action,
CASE l WHEN 'ALERT' THEN 'immediate' WHEN 'BORDERLINE' THEN 'within_24h' WHEN 'MONITOR' THEN 'weekly' ELSE 'none' END AS urgency,
'Score ' || printf('%.4f', round_even(score, 4)) || CASE l WHEN 'ALERT' THEN ' >= frozen alert threshold 0.6000' WHEN 'BORDERLINE' THEN ' in borderline zone [0.5500, 0.6000)' WHEN 'MONITOR' THEN ' in monitor zone [0.4000, 0.5500)' ELSE ' < conformal threshold 0.4000' END
 || CASE WHEN len(fl) > 0 THEN '; ' || len(fl) || ' trust flag(s) active' ELSE '' END AS rationale, array_to_string(fl, '|') AS trust_flags, CAST(len(fl) AS INTEGER) AS n_trust_flags,
{' || \'|\' || '.join(f"'{f}=' || printf('%.6f', {f}::DOUBLE)" for f in decision.GRAPH)} AS graph_features,
(SELECT string_agg(f || '=' || printf('%.6f', round(v, 6)), '|' ORDER BY abs(v) DESC, i) FROM (SELECT *, row_number() OVER (ORDER BY abs(v) DESC, i) AS r FROM (SELECT unnest([{", ".join(f"'{f}'" for f in MODEL)}]) AS f, unnest([{", ".join(f"{f}::DOUBLE" for f in MODEL)}]) AS v, unnest(range(0, {len(MODEL)})) AS i)) WHERE r <= 3) AS top_reasons
FROM (SELECT pv.*, {', '.join(f'base.{f}' for f in MODEL)}, {LEVEL.replace("score", "pv.score")} AS l, {CATEGORY.format(a=0.05)} AS c, {FLAGS} AS fl FROM pv JOIN base USING (user_id, day))""", SCORED_SQL + ",\n" + CONF)
def decision_table(spark, sf):
    p = parts(spark, sf)
    df = decision.decision_table(p["test"], p["calibration"], MODEL, alert=0.6, monitor=0.4)
    values = F.array_join(F.transform(F.map_entries("graph_features"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))), "|")
    reasons = F.array_join(F.transform("top_reasons", lambda x: F.concat(x["feature"], F.lit("="), F.format_string("%.6f", x["value"]))), "|")
    return rounded(df.withColumns({"trust_flags": F.array_join("trust_flags", "|"), "graph_features": values, "top_reasons": reasons}))


@query(f"SELECT {LEVEL} AS risk_level, count(*) AS n FROM base GROUP BY ALL")
def level_counts(spark, sf):
    from vigilake.functions.scalar import risk_level

    return decision.level_counts(scored(spark, sf).withColumn("risk_level", risk_level(F.col("score"), 0.6, 0.05, 0.4)))


@query("""SELECT user_id, day, string_agg(f || '=' || printf('%.6f', round(v, 6)), '|' ORDER BY abs(v) DESC, i) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY abs(v) DESC, i) AS r FROM (
 SELECT user_id, day, unnest([""" + ", ".join(f"'{f}'" for f in MODEL) + """]) AS f, unnest([""" + ", ".join(f"{f}::DOUBLE" for f in MODEL) + """]) AS v, unnest(range(0, """ + str(len(MODEL)) + """)) AS i FROM base)) WHERE r <= 3 GROUP BY ALL""")
def top_reasons(spark, sf):
    df = scored(spark, sf).withColumn("r", decision.top_reasons(MODEL, 3, contributions=False))
    return df.select("user_id", "day", F.array_join(F.transform("r", lambda x: F.concat(x["feature"], F.lit("="), F.format_string("%.6f", x["value"]))), "|").alias("reasons"))


WEIGHTS = {"after_hours_login_count": 0.4, "unusual_access_count": 0.3, "usb_connection_count": -0.2}
MEANS = {"after_hours_login_count": 1.0, "unusual_access_count": 0.5, "usb_connection_count": 0.25}


@query("""SELECT feature, round(avg(abs(c)), 6) AS mean_abs, round(median(abs(c)), 6) AS median_abs, round(avg(abs(c)) / sum(avg(abs(c))) OVER (), 6) AS share, round(avg((c > 0)::INT), 6) AS positive_share, count(*) FILTER (r = 1) AS top1 FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY abs(c) DESC, i) AS r FROM (SELECT user_id, day, unnest(['after_hours_login_count', 'unusual_access_count', 'usb_connection_count']) AS feature, unnest([0, 1, 2]) AS i,
 unnest([0.4::DOUBLE * (after_hours_login_count - 1.0::DOUBLE), 0.3::DOUBLE * (unusual_access_count - 0.5::DOUBLE), -0.2::DOUBLE * (usb_connection_count - 0.25::DOUBLE)]) AS c FROM base)) GROUP BY feature""")
def global_importance(spark, sf):
    return rounded(decision.global_importance(decision.linear_contributions(scored(spark, sf), WEIGHTS, MEANS), list(WEIGHTS)))


@query()
def contribution_reconstruction(spark, sf):
    """The margin that the fitted trees give themselves against the bias and contributions of their export."""
    df = scored(spark, sf)
    model = learned.fit_trees(df.filter("split = 'train'"), MODEL)
    made = treeshap.tree_contributions(model, df, MODEL, ["user_id", "day"]).drop("margin")
    own = learned.margin(model, df).select("user_id", "day", "margin")
    return decision.reconstruction(made.join(own, ["user_id", "day"]), MODEL, F.col("bias")).select((F.col("max_gap") < 1e-6).alias("exact"), F.lit(len(MODEL)).alias("n_features"))


@query("""SELECT user_id, day, score, category FROM (SELECT *, CASE WHEN score >= 0.6 THEN 'alert' WHEN score >= 0.55 THEN 'borderline' WHEN score >= 0.4 THEN 'monitor' END AS category FROM base) WHERE category IS NOT NULL UNION ALL
SELECT user_id, day, score, 'sample' FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY day, user_id) AS r FROM (SELECT b.*, (SELECT count(*) FROM (SELECT unnest(q) AS c) WHERE c < b.score) AS d FROM base b
 CROSS JOIN (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM base WHERE score < 0.4) WHERE b.score < 0.4)) WHERE r <= 50""")
def explanation_selection(spark, sf):
    return decision.explanation_selection(scored(spark, sf), 0.4, 0.6, 0.05, 50)


@query("""SELECT feature, round(avg(d), 6) AS mean_delta, count(*) FILTER ((round(m + d, 9) >= 0.5) <> (round(m, 9) >= 0.5)) AS n_flips FROM (SELECT 0.4 * after_hours_login_count + 0.3 * unusual_access_count - 0.2 * usb_connection_count AS m, unnest(['after_hours_login_count', 'unusual_access_count', 'usb_connection_count']) AS feature, unnest([0.4, 0.3, -0.2]) AS d
FROM (SELECT after_hours_login_count::DOUBLE AS after_hours_login_count, unusual_access_count::DOUBLE AS unusual_access_count, usb_connection_count::DOUBLE AS usb_connection_count FROM base)) GROUP BY feature""")
def perturbation_stability(spark, sf):
    margin = lambda x: F.round(sum((F.lit(w) * x[f] for f, w in WEIGHTS.items()), F.lit(0.0)), 9)
    return rounded(decision.perturbation(scored(spark, sf), WEIGHTS, dict.fromkeys(WEIGHTS, 1.0), 0.5, margin))


@query("SELECT w AS \"window\", count(*) AS n, round(avg(score), 6) AS mean_score FROM win GROUP BY w", SCORED_SQL + ",\n" + WIN)
def window_scores(spark, sf):
    return rounded(policies.day_windows(scored(spark, sf), days=7).groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")))


@query()
def bootstrap_auc(spark, sf):
    return rounded(resampling.bootstrap_ci(scored(spark, sf), 1000))


@query()
def bootstrap_user_blocks(spark, sf):
    return rounded(resampling.operating_ci(scored(spark, sf), 1000))


@query()
def bootstrap_paired_delta(spark, sf):
    return rounded(resampling.paired_delta(scored(spark, sf).withColumn("other", F.col("login_count").cast("double")), "other", "score", 1000, key=("user_id",)))


@query()
def bootstrap_threshold(spark, sf):
    return rounded(resampling.threshold_ci(scored(spark, sf), 200))


@query()
def bootstrap_platt_refit(spark, sf):
    p = parts(spark, sf)
    return rounded(resampling.platt_refit(p["calibration"], p["test"], 1000))


@query()
def gbt_scores(spark, sf):
    p = parts(spark, sf)
    model = learned.fit_trees(p["train"], MODEL, validation=p["calibration"], rounds=20, depth=4)
    return rounded(learned.predict(model, p["test"].drop("score")).select("user_id", "day", "is_malicious", "score"))


@query()
def oof_scores(spark, sf):
    df = scored(spark, sf).drop("score")
    folds = resampling.round_robin(df, 4)  # with five, all malicious users of these tables, every fifth, would be in one
    return rounded(learned.out_of_fold(df, folds, 4, lambda t: learned.fit_trees(t, MODEL, rounds=5, depth=4)).select("user_id", "day", "fold", "oof"))


@query()
def fusion_weights(spark, sf):
    df = scored(spark, sf).withColumn("a", 1 - F.col("device_consistency_score")).withColumn("b", 1 - F.col("file_type_consistency_score"))
    w = components.fit_fusion(df, ["score", "a", "b"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in w.items()], "component string, weight double")


NEWTON = """cn AS MATERIALIZED (SELECT score AS s, count(*)::DOUBLE AS n, sum(alert::INT)::DOUBLE AS k FROM base WHERE split = 'train' GROUP BY score),
nw AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
  SELECT i + 1, a - (ga * hbb - gb * hab) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT i, a, b, sum((n * p - k) * s) + a AS ga, sum(n * p - k) AS gb, sum(n * p * (1 - p) * s * s) + 1.0 AS haa, sum(n * p * (1 - p) * s) AS hab, sum(n * p * (1 - p)) + 1e-9 AS hbb
    FROM (SELECT *, 1.0 / (1.0 + exp(-greatest(-30.0, least(30.0, a * s + b)))) AS p FROM nw CROSS JOIN cn WHERE i < 25) GROUP BY i, a, b))"""


@query("SELECT user_id, day, round(1.0 / (1.0 + exp(-greatest(-30.0, least(30.0, a * score + b)))), 6) AS p FROM base CROSS JOIN (SELECT a, b FROM nw WHERE i = 25) WHERE split = 'test'", "RECURSIVE " + SCORED_SQL.replace("sc AS (", "sc AS MATERIALIZED (").strip() + ",\n" + NEWTON)
def platt_calibrated(spark, sf):
    p = parts(spark, sf)
    a, b = calibration.fit_platt(p["train"].withColumn("y", F.col("alert").cast("int")), "score", "y")
    from vigilake.functions.scalar import sigmoid

    return rounded(p["test"].select("user_id", "day", sigmoid(F.lit(a) * F.col("score") + F.lit(b), 30.0).alias("p")))


@query()
def binned_calibration(spark, sf):
    p = parts(spark, sf)
    bins = calibration.fit_bins(p["train"], 20, 30, 2, "score", "is_malicious")
    return rounded(p["test"].select("user_id", "day", calibration.apply_bins(F.col("score"), bins).alias("p")))


@query("""SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / count(*), 6) AS tau FROM v a JOIN v b ON a.item < b.item""",
       "v AS (SELECT event_type AS item, count(*)::DOUBLE AS x, sum(value)::DOUBLE AS y FROM events GROUP BY event_type)")
def kendall_tau(spark, sf):
    v = adapters.table(spark, sf, "events").groupBy(F.col("event_type").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum("value").alias("y"))
    return rounded(metrics.kendall_tau(v.select("item", F.col("x").alias("value")), v.select("item", F.col("y").alias("value"))))
