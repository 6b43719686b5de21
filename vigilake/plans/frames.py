"""The frames that the registered queries start from, over the ``events`` table, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.scalar import SENSITIVE_PREFIXES
from vigilake.operators import features, graph
from vigilake.sources import adapters
from vigilake.sources.scratch import written

WINDOW, TRAIN_END, CALIBRATION_END, AT = 7, "2024-01-18", "2024-01-24", 0.5


def logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ev = adapters.events(spark, sf_dir)
    return {"events": ev, "logon": adapters.logon(ev), "device": adapters.device(ev), "file": adapters.file(ev), "http": adapters.http(ev)}


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = adapters.events(spark, sf_dir)
    span = ev.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()  # two dates
    return features.user_day_grid(ev, span["a"], span["b"])


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.user_day_table(logs(spark, sf_dir), grid(spark, sf_dir), WINDOW)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-days with counts, graph features, label, surrogate score, split and alert, written once for the query that asks."""
    held = logs(spark, sf_dir)
    base = user_days(spark, sf_dir)
    base = graph.graph_features(held["logon"], held["file"], adapters.departments(held["events"]), base)
    base = features.label_days(base, adapters.incidents(held["events"]))
    part = lambda c: F.least(F.col(c), F.lit(4)) / F.lit(4.0)
    score = 0.25 * part("after_hours_login_count") + 0.25 * part("unusual_access_count") + 0.25 * (1 - F.col("device_consistency_score")) + 0.25 * part("usb_connection_count")
    base = base.withColumn("score", F.round(F.least(F.lit(1.0), score), 6)).withColumn("split", features.split_of(F.col("day"), TRAIN_END, CALIBRATION_END))
    return written(base.withColumn("alert", F.col("score") >= AT), "scored")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_PREFIX = SENSITIVE_PREFIXES

LOGS_SQL = f"""
ev AS (SELECT event_id AS id, ts, CAST(ts AS DATE) AS day, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events),
users AS (SELECT DISTINCT user_id FROM ev),
days AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM ev)::TIMESTAMP, (SELECT max(day) FROM ev)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day),
grid AS (SELECT user_id, day FROM users CROSS JOIN days),
logon AS (SELECT *, 'PC-' || lpad(CAST(k % 25 AS VARCHAR), 4, '0') AS pc, CASE WHEN event_type = 'error' THEN 'Logoff' ELSE 'Logon' END AS activity FROM ev),
device AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'Connect' ELSE 'Disconnect' END AS activity FROM ev WHERE event_type IN ('signup', 'purchase')),
file AS (SELECT *, CASE k % 10 WHEN 0 THEN '{_PREFIX[0]}' WHEN 1 THEN '{_PREFIX[1]}' WHEN 2 THEN '{_PREFIX[2]}' ELSE 'other' END AS type FROM ev WHERE event_type IN ('purchase', 'click')),
http AS (SELECT * FROM ev WHERE event_type IN ('view', 'click')),
incidents AS (SELECT user_id, CAST(user_id % 3 + 1 AS INTEGER) AS scenario, DATE '2024-01-05' + CAST(user_id * 7 % 22 AS INTEGER) AS start, DATE '2024-01-05' + CAST(user_id * 7 % 22 AS INTEGER) + 3 AS "end" FROM users WHERE user_id % 5 = 2),
ldap AS (SELECT DATE '2023-12-01' AS m, user_id, user_id % 5 AS department FROM users UNION ALL SELECT DATE '2024-01-01', user_id, (user_id + 1) % 5 FROM users)"""

FEATURES_SQL = (
    LOGS_SQL
    + f""",
lf AS (SELECT user_id, day, count(*) AS login_count, count(*) FILTER (hour(ts) < 8 OR hour(ts) >= 18) AS after_hours_login_count, count(DISTINCT pc) AS unique_device_count FROM logon WHERE activity = 'Logon' GROUP BY ALL),
df AS (SELECT user_id, day, count(*) AS usb_connection_count FROM device WHERE activity = 'Connect' GROUP BY ALL),
ff AS (SELECT user_id, day, count(*) AS file_access_count, count(*) FILTER (type <> 'other') AS sensitive_file_access_count FROM file GROUP BY ALL),
hf AS (SELECT user_id, day, count(*) AS http_activity_count FROM http GROUP BY ALL),
uf AS (SELECT user_id, day, count(*) AS unusual_access_count FROM logon l WHERE activity = 'Logon' AND NOT EXISTS (
    SELECT 1 FROM logon p WHERE p.activity = 'Logon' AND p.user_id = l.user_id AND p.pc = l.pc AND p.day < l.day AND p.day >= l.day - {WINDOW}) GROUP BY ALL),
ud AS (SELECT user_id, day, coalesce(login_count, 0) AS login_count, coalesce(after_hours_login_count, 0) AS after_hours_login_count, coalesce(usb_connection_count, 0) AS usb_connection_count,
    coalesce(file_access_count, 0) AS file_access_count, coalesce(sensitive_file_access_count, 0) AS sensitive_file_access_count, coalesce(http_activity_count, 0) AS http_activity_count,
    coalesce(unique_device_count, 0) AS unique_device_count, coalesce(unusual_access_count, 0) AS unusual_access_count
    FROM grid LEFT JOIN lf USING (user_id, day) LEFT JOIN df USING (user_id, day) LEFT JOIN ff USING (user_id, day) LEFT JOIN hf USING (user_id, day) LEFT JOIN uf USING (user_id, day))"""
)

SCORED_SQL = (
    FEATURES_SQL
    + """,
pcd AS (SELECT DISTINCT user_id, pc, day FROM logon WHERE activity = 'Logon'),
pfirst AS (SELECT user_id, pc, min(day) AS f FROM pcd GROUP BY ALL),
dev AS (SELECT user_id, day, count(*) AS n_day, count(*) FILTER (f < day) AS n_both, count(*) FILTER (f >= day) AS n_new FROM pcd JOIN pfirst USING (user_id, pc) GROUP BY ALL),
dev2 AS (SELECT dev.*, (SELECT count(*) FROM pfirst p WHERE p.user_id = dev.user_id AND p.f < dev.day) AS n_past FROM dev),
tyd AS (SELECT user_id, type, day, count(*) AS n FROM file GROUP BY ALL),
tfirst AS (SELECT user_id, type, min(day) AS f FROM tyd GROUP BY ALL),
typ AS (SELECT user_id, day, count(*) AS n_day, count(*) FILTER (f < day) AS n_both, coalesce(sum(n) FILTER (f >= day), 0) AS n_new FROM tyd JOIN tfirst USING (user_id, type) GROUP BY ALL),
typ2 AS (SELECT typ.*, (SELECT count(*) FROM tfirst p WHERE p.user_id = typ.user_id AND p.f < typ.day) AS n_past FROM typ),
fdep AS (SELECT f.*, l.department FROM file f JOIN ldap l ON l.user_id = f.user_id AND l.m = CAST(date_trunc('month', f.day) - INTERVAL 1 MONTH AS DATE)),
dfirst AS (SELECT department, type, min(day) AS f FROM fdep GROUP BY ALL),
mis AS (SELECT user_id, day, count(*) FILTER (f >= day) AS n FROM fdep JOIN dfirst USING (department, type) GROUP BY ALL),
gf AS (SELECT ud.*, CASE WHEN d.n_day > 0 AND d.n_past > 0 THEN d.n_both::DOUBLE / (d.n_day + d.n_past - d.n_both) ELSE 0.0 END AS device_consistency_score, coalesce(d.n_new, 0) AS rare_device_usage_count,
    CASE WHEN t.n_day > 0 AND t.n_past > 0 THEN t.n_both::DOUBLE / (t.n_day + t.n_past - t.n_both) ELSE 0.0 END AS file_type_consistency_score, CAST(coalesce(t.n_new, 0) AS BIGINT) AS rare_file_type_access_count, coalesce(mis.n, 0) AS department_file_type_mismatch_count
    FROM ud LEFT JOIN dev2 d USING (user_id, day) LEFT JOIN typ2 t USING (user_id, day) LEFT JOIN mis USING (user_id, day)),
lab AS (SELECT gf.*, CASE WHEN EXISTS (SELECT 1 FROM incidents i WHERE i.user_id = gf.user_id AND gf.day BETWEEN i.start AND i."end") THEN 1 ELSE 0 END AS is_malicious FROM gf),
sc AS (SELECT *, round(least(1.0, 0.25 * (least(after_hours_login_count, 4) / 4.0) + 0.25 * (least(unusual_access_count, 4) / 4.0) + 0.25 * (1 - device_consistency_score) + 0.25 * (least(usb_connection_count, 4) / 4.0)), 6) AS score FROM lab),
"""
    + f"""
base AS (SELECT *, CASE WHEN day <= DATE '{TRAIN_END}' THEN 'train' WHEN day <= DATE '{CALIBRATION_END}' THEN 'calibration' ELSE 'test' END AS split, score >= {AT} AS alert FROM sc)"""
)
