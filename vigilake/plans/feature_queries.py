"""Queries of sources, checks, features, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.operators import features, graph, policies, quality, resampling
from vigilake.plans.frames import CALIBRATION_END, FEATURES_SQL, LOGS_SQL, SCORED_SQL, TRAIN_END, WINDOW, grid, logs, rounded, scored, user_days
from vigilake.sources import adapters, readers

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, start: str = LOGS_SQL):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {start.strip()}\n{sql.strip()}" if start else sql.strip()
        return f

    return keep


@query("SELECT * FROM lf", FEATURES_SQL)
def user_day_logon(spark, sf):
    return features.logon_features(logs(spark, sf)["logon"])


@query("SELECT * FROM df", FEATURES_SQL)
def user_day_device(spark, sf):
    return features.device_features(logs(spark, sf)["device"])


@query("SELECT * FROM ff", FEATURES_SQL)
def user_day_file(spark, sf):
    return features.file_features(logs(spark, sf)["file"])


@query("SELECT * FROM hf", FEATURES_SQL)
def user_day_http(spark, sf):
    return features.http_features(logs(spark, sf)["http"])


@query("SELECT * FROM uf", FEATURES_SQL)
def unusual_access_lag(spark, sf):
    return features.unusual_access(logs(spark, sf)["logon"], WINDOW)


@query("SELECT * FROM uf", FEATURES_SQL)
def unusual_access_join(spark, sf):
    return features.unusual_access_join(logs(spark, sf)["logon"], WINDOW)


@query("SELECT * FROM ud", FEATURES_SQL)
def user_day_grid_features(spark, sf):
    return user_days(spark, sf)


@query("SELECT user_id, pc, f AS first_day FROM pfirst", SCORED_SQL)
def first_use(spark, sf):
    return graph.first_use(logs(spark, sf)["logon"].filter("activity = 'Logon'"), "user_id", "pc")


@query("SELECT user_id, day, (SELECT count(*) FROM pfirst p WHERE p.user_id = grid.user_id AND p.f < grid.day) AS n_past FROM grid", SCORED_SQL)
def past_set_size(spark, sf):
    first = graph.first_use(logs(spark, sf)["logon"].filter("activity = 'Logon'"), "user_id", "pc")
    return graph.past_set_size(first, "user_id", grid(spark, sf))


@query("SELECT user_id, day, round(device_consistency_score, 6) AS device_consistency_score, rare_device_usage_count, round(file_type_consistency_score, 6) AS file_type_consistency_score, rare_file_type_access_count, department_file_type_mismatch_count FROM gf", SCORED_SQL)
def graph_features(spark, sf):
    held = logs(spark, sf)
    return rounded(graph.graph_features(held["logon"], held["file"], adapters.departments(held["events"]), grid(spark, sf)))


@query("SELECT g.user_id, g.day, l.department FROM grid g LEFT JOIN ldap l ON l.user_id = g.user_id AND l.m = CAST(date_trunc('month', g.day) - INTERVAL 1 MONTH AS DATE)")
def department_last_month(spark, sf):
    return graph.department_of_day(grid(spark, sf), adapters.departments(logs(spark, sf)["events"])).select("user_id", "day", "department")


@query("SELECT g.user_id, g.day, (SELECT arg_max(l.department, l.m) FROM ldap l WHERE l.user_id = g.user_id AND l.m < date_trunc('month', g.day)) AS department FROM grid g")
def department_asof(spark, sf):
    return graph.department_of_day(grid(spark, sf), adapters.departments(logs(spark, sf)["events"]), asof=True).select("user_id", "day", "department")


@query("SELECT user_id, day, is_malicious FROM lab", SCORED_SQL)
def labels_range_join(spark, sf):
    return features.label_days(grid(spark, sf), adapters.incidents(logs(spark, sf)["events"]))


@query("SELECT * EXCLUDE (device_consistency_score, file_type_consistency_score), round(device_consistency_score, 6) AS device_consistency_score, round(file_type_consistency_score, 6) AS file_type_consistency_score FROM base", SCORED_SQL)
def scored_user_days(spark, sf):
    return rounded(scored(spark, sf))


@query("SELECT count(*) FILTER (ts IS NULL) AS unparseable, min(ts) AS first, max(ts) AS last, count(DISTINCT day) AS n_days FROM ev")
def dq_timestamps(spark, sf):
    return quality.timestamps(logs(spark, sf)["events"])


@query("SELECT count(*) - count(DISTINCT o_custkey) AS duplicate_ids, count(*) FILTER (NOT regexp_matches(CAST(o_custkey AS VARCHAR), '^[1-9][0-9]*$')) AS bad_format FROM orders", "")
def dq_ids(spark, sf):
    return quality.ids(adapters.table(spark, sf, "orders"), "o_custkey", "^[1-9][0-9]*$")


@query("""SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column",
  unnest([count(*) - count(o_orderkey), count(*) - count(o_custkey), count(*) - count(o_orderstatus), count(*) - count(o_totalprice), count(*) - count(o_orderdate), count(*) - count(o_orderpriority)]) AS n_missing FROM orders""", "")
def dq_missing(spark, sf):
    return quality.missing(adapters.table(spark, sf, "orders"))


@query("SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS duplicate_rows", "")
def dq_duplicates(spark, sf):
    return quality.duplicates(adapters.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"))


@query("SELECT count(*) FILTER (event_type IS NULL OR event_type NOT IN ('view', 'click', 'purchase')) AS outside FROM events", "")
def dq_allowed(spark, sf):
    return quality.allowed_values(adapters.table(spark, sf, "events"), "event_type", ["view", "click", "purchase"])


@query("SELECT count(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS outside FROM lineitem", "")
def dq_range(spark, sf):
    return quality.numeric_range(adapters.table(spark, sf, "lineitem"), "l_quantity", 5, 45)


@query("""SELECT 'device' AS file, (SELECT count(DISTINCT user_id) FROM device) AS n_users, (SELECT count(*) FROM users WHERE user_id NOT IN (SELECT user_id FROM device)) AS missing, 0::BIGINT AS extra
UNION ALL SELECT 'file', (SELECT count(DISTINCT user_id) FROM file), (SELECT count(*) FROM users WHERE user_id NOT IN (SELECT user_id FROM file)), 0""")
def dq_coverage(spark, sf):
    held = logs(spark, sf)
    return quality.user_coverage(held["events"], {"device": held["device"], "file": held["file"]})


@query("""SELECT scenario, count(*) AS n, count(DISTINCT user_id) AS n_users, 0::BIGINT AS bad_dates, count(DISTINCT user_id) FILTER (user_id NOT IN (SELECT user_id FROM device)) AS unknown_users
FROM incidents GROUP BY GROUPING SETS ((scenario), ())""")
def dq_labels(spark, sf):
    held = logs(spark, sf)
    return quality.label_audit(adapters.incidents(held["events"]), held["device"])


@query("""SELECT 'logon' AS file, c.check, c.value, c.value = 0 AS ok FROM (SELECT unnest(['bad_pc', 'null_day', 'unknown_activity', 'repeated_rows']) AS "check",
  unnest([count(*) FILTER (NOT regexp_matches(pc, '^PC-\\d{4}$')), count(*) FILTER (day IS NULL), count(*) FILTER (activity NOT IN ('Logon')), 0]) AS value FROM logon) c""")
def dq_battery(spark, sf):
    df = logs(spark, sf)["logon"]
    return quality.file_battery(df, "logon", {"bad_pc": ~F.col("pc").rlike(r"^PC-\d{4}$"), "null_day": F.col("day").isNull(), "unknown_activity": ~F.col("activity").isin("Logon")})


@query("SELECT CAST(NULL AS VARCHAR) AS file, 3::BIGINT AS n_checks, 1::BIGINT AS n_failed, false AS ok UNION ALL SELECT 'http', 1, 0, true UNION ALL SELECT 'logon', 2, 1, false", "")
def dq_summary(spark, sf):
    held = logs(spark, sf)
    a = quality.file_battery(held["logon"], "logon", {"unknown_activity": ~F.col("activity").isin("Logon")})
    b = quality.file_battery(held["http"], "http", {}).filter("check = 'repeated_rows'")
    return quality.summary([a, b])


@query("SELECT split, count(*) AS n_rows, count(DISTINCT day) AS n_days, count(DISTINCT user_id) AS n_users, CAST(sum(is_malicious) AS BIGINT) AS n_malicious, min(day) AS first_day, max(day) AS last_day FROM base GROUP BY ALL", SCORED_SQL)
def chrono_split_summary(spark, sf):
    held = features.label_days(grid(spark, sf), adapters.incidents(logs(spark, sf)["events"]))
    return features.split_summary(held, TRAIN_END, CALIBRATION_END)


@query("SELECT count(*) AS n_base, (SELECT count(*) FROM uf) AS n_extra, 0::BIGINT AS base_repeats, 0::BIGINT AS extra_repeats, count(*) - (SELECT count(*) FROM uf) AS missing_in_extra, 0::BIGINT AS missing_in_base FROM grid", FEATURES_SQL)
def key_alignment(spark, sf):
    return features.align(grid(spark, sf), features.unusual_access(logs(spark, sf)["logon"], WINDOW))


@query("SELECT w AS window, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS n_days, count(*) AS n_rows FROM grid JOIN (SELECT day, CAST(ntile(4) OVER (ORDER BY day) - 1 AS INTEGER) AS w FROM days) USING (day) GROUP BY ALL")
def window_ntile(spark, sf):
    return policies.window_bounds(policies.day_windows(grid(spark, sf), n=4))


@query("SELECT w AS window, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS n_days, count(*) AS n_rows FROM grid JOIN (SELECT day, CAST((row_number() OVER (ORDER BY day) - 1) // 7 AS INTEGER) AS w FROM days) USING (day) GROUP BY ALL")
def window_chunks(spark, sf):
    return policies.window_bounds(policies.day_windows(grid(spark, sf), days=7))


@query("SELECT CAST(floor(date_diff('day', DATE '2024-01-03', day) / 7.0) AS INTEGER) AS window, count(*) AS n FROM ev GROUP BY ALL")
def window_calendar(spark, sf):
    ev = logs(spark, sf)["events"]
    return ev.groupBy(policies.calendar_windows(F.col("day"), "2024-01-03").alias("window")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, CAST((row_number() OVER (ORDER BY user_id) - 1) % 5 AS INTEGER) AS fold FROM users")
def round_robin_folds(spark, sf):
    return resampling.round_robin(logs(spark, sf)["events"], 5)


@query("""SELECT user_id, malicious, CASE WHEN m < 8 THEN 'train' WHEN m < CASE malicious WHEN 1 THEN 11 ELSE 9 END THEN 'calibration' ELSE 'test' END AS block FROM (
  SELECT user_id, malicious, (row_number() OVER (PARTITION BY malicious ORDER BY onset, user_id) - 1) % CASE malicious WHEN 1 THEN 14 ELSE 10 END AS m FROM (
    SELECT user_id, max(is_malicious) AS malicious, min(day) FILTER (is_malicious = 1) AS onset FROM lab GROUP BY ALL))""", SCORED_SQL)
def user_allocation(spark, sf):
    return resampling.allocate(features.label_days(grid(spark, sf), adapters.incidents(logs(spark, sf)["events"])))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS user FROM ev")
def distinct_users(spark, sf):
    return readers.distinct_users(logs(spark, sf)["events"], "user_id")


@query()
def canonical_digest(spark, sf):
    return readers.canonical_digest(adapters.table(spark, sf, "nation"))
