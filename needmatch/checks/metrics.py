"""Metric, alert, health and log queries."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..operators import metrics as mt
from .access import AUTH_SQL, authed
from .fixtures import fx
from .registry import query


def seconds(spark, d):
    """Requests with a duration in seconds that spreads over the default buckets."""
    return fx(spark, d, "fx_requests").withColumn("seconds", F.col("duration_ms") / 100)


@query("m1_counters", f"""
WITH {AUTH_SQL}
SELECT 'events_published_total' AS metric, '{{"project_id":"' || project_id || '"}}' AS labels, count(*) AS value FROM fx_log GROUP BY 1, 2
UNION ALL SELECT 'http_requests_total', '{{"method":"' || method || '","status_code":"' || status_code || '"}}', count(*) FROM fx_requests GROUP BY 1, 2
UNION ALL SELECT 'auth_attempts_total', '{{"status":"' || coalesce(failure, 'success') || '"}}', count(*) FROM au GROUP BY 1, 2
UNION ALL SELECT 'webhook_deliveries_total', '{{"status":"' || CASE WHEN status_code = 200 THEN 'success' ELSE 'failed' END || '"}}', count(*) FROM fx_deliveries GROUP BY 1, 2
UNION ALL SELECT 'retries_total', '{{"attempt":"' || attempt || '"}}', count(*) FROM fx_deliveries WHERE attempt > 1 GROUP BY 1, 2""")
def m1(spark, d):
    dl = fx(spark, d, "fx_deliveries")
    ok = F.when(F.coalesce(F.col("status_code") == 200, F.lit(False)), "success").otherwise("failed")
    parts = [
        mt.counters(fx(spark, d, "fx_log"), "events_published_total", {"project_id": F.col("project_id")}),
        mt.counters(fx(spark, d, "fx_requests"), "http_requests_total", {"method": F.col("method"), "status_code": F.col("status_code")}),
        mt.counters(authed(spark, d), "auth_attempts_total", {"status": F.coalesce("failure", F.lit("success"))}),
        mt.counters(dl, "webhook_deliveries_total", {"status": ok}),
        mt.counters(dl.filter("attempt > 1"), "retries_total", {"attempt": F.col("attempt")})]
    return reduce(DataFrame.unionByName, parts)


def hist_sql(source, labels, value, bounds=C.HISTOGRAM_BOUNDS):
    b = ", ".join(f"({x}::DOUBLE)" for x in bounds) + ", ('inf'::DOUBLE)"
    return f"""hb(le) AS (VALUES {b}),
hh AS (SELECT {labels}, le, count(*) FILTER ({value} <= le) AS bucket, sum({value}) AS sum, count({value}) AS count FROM {source}, hb GROUP BY {labels}, le)"""


REQ = "rq AS (SELECT *, duration_ms / 100 AS seconds FROM fx_requests)"


@query("m2_histogram", f"WITH {REQ}, {hist_sql('rq', 'project_id', 'seconds')} SELECT project_id, le, bucket, round(sum, 4) AS sum, count FROM hh")
def m2(spark, d):
    return mt.histogram(seconds(spark, d), "seconds", ["project_id"]).withColumn("sum", F.round("sum", 4))


QUANT_SQL = """
ql AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(bucket) OVER w, 0) AS below, 0.95::DOUBLE * count AS rk FROM hh WINDOW w AS (PARTITION BY {0} ORDER BY le)),
qv AS (SELECT {0}, arg_min(CASE WHEN isinf(le) THEN lo WHEN bucket = below THEN le ELSE lo + (le - lo) * ((rk - below) / (bucket - below)) END, le) AS quantile
  FROM ql WHERE bucket >= rk AND count > 0 GROUP BY {0})"""


@query("m3_histogram_quantile", f"WITH {REQ}, {hist_sql('rq', 'project_id, method', 'seconds')}, {QUANT_SQL.format('project_id, method')} SELECT project_id, method, round(quantile, 6) AS quantile FROM qv")
def m3(spark, d):
    h = mt.histogram(seconds(spark, d), "seconds", ["project_id", "method"])
    return mt.histogram_quantile(h, ["project_id", "method"], 0.95).withColumn("quantile", F.round("quantile", 6))


INC_SQL = """
lg AS (SELECT *, lag(value) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS prev FROM fx_counter),
ic AS (SELECT project_id, date_trunc('hour', ts) AS window_start, CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) AS BIGINT) AS increase FROM lg GROUP BY 1, 2)"""


def hourly(spark, d):
    return mt.increase(fx(spark, d, "fx_counter"), ["project_id"], "value", "ts", "event_id", "1 hour", 3600)


@query("m4_increase", f"WITH {INC_SQL} SELECT *, round(increase / 3600.0::DOUBLE, 9) AS rate FROM ic")
def m4(spark, d):
    return hourly(spark, d).withColumn("rate", F.round("rate", 9))


@query("m4_increase_sliding", """
WITH lg AS (SELECT *, lag(value) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS prev FROM fx_counter),
dl AS (SELECT project_id, ts, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS dv FROM lg),
w AS (SELECT project_id, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS window_start, dv FROM dl, range(2) r(k))
SELECT project_id, window_start, CAST(sum(dv) AS BIGINT) AS increase FROM w GROUP BY 1, 2""")
def m4s(spark, d):
    return mt.increase(fx(spark, d, "fx_counter"), ["project_id"], "value", "ts", "event_id", "1 hour", 3600, "30 minutes").drop("rate")


@query("m5_sum_by", f"WITH {INC_SQL} SELECT project_id, CAST(sum(increase) AS BIGINT) AS total FROM ic GROUP BY 1")
def m5(spark, d):
    return mt.sum_by(hourly(spark, d), ["project_id"])


@query("m5_gauge_last", "SELECT project_id, arg_max(value, ts) AS value FROM fx_counter GROUP BY 1")
def m5g(spark, d):
    return mt.gauge_last(fx(spark, d, "fx_counter"), ["project_id"], "value", "ts", "event_id")


@query("m6_ratio", """
SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (status_code >= 500 AND method = 'POST') / nullif(count(*) FILTER (method = 'POST'), 0) AS ratio FROM fx_requests GROUP BY 1""")
def m6(spark, d):
    return mt.ratio(fx(spark, d, "fx_requests"), F.col("status_code") >= 500, F.col("method") == "POST", [F.date_trunc("hour", "ts").alias("hour")])


@query("m7_avg_from_hist", f"WITH {REQ}, {hist_sql('rq', 'project_id', 'seconds')} SELECT DISTINCT project_id, round(sum / count, 6) AS mean FROM hh")
def m7(spark, d):
    h = mt.histogram(seconds(spark, d), "seconds", ["project_id"]).withColumn("sum", F.round("sum", 9))
    return mt.avg_from_hist(h, ["project_id"]).withColumn("mean", F.round("mean", 6))


@query("m8_topk_by_label", f"WITH {INC_SQL} SELECT project_id, CAST(sum(increase) AS BIGINT) AS total FROM ic WHERE window_start >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def m8(spark, d):
    last = hourly(spark, d).filter(F.col("window_start") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return mt.topk(mt.sum_by(last, ["project_id"]), "project_id", "total")


@query("m9_count_distinct_series", "SELECT count(DISTINCT raw_key) AS series FROM fx_requests")
def m9(spark, d):
    return mt.count_series(fx(spark, d, "fx_requests"), "raw_key")


@query("m10_label_match", "SELECT request_id FROM fx_requests WHERE regexp_full_match(CAST(status_code AS VARCHAR), '4..|5..') AND method <> 'GET' AND NOT regexp_full_match(path, '/api/p.*')")
def m10(spark, d):
    return mt.label_filter(fx(spark, d, "fx_requests"), status_code=("=~", "4..|5.."), method=("!=", "GET"), path=("!~", "/api/p.*")).select("request_id")


SAMPLES = """
SELECT 'registered_agents' AS series, concat('p', user_id % 2) AS label, event_id AS id, ts, CAST(CASE WHEN event_id % 7 < 6 THEN 0 ELSE 1 + user_id % 5 END AS DOUBLE) AS value
FROM events
UNION ALL SELECT 'memory_bytes', concat('i', user_id % 3), event_id, ts, CAST(2147483648 + (event_id % 5 - 1) * 1000000 AS DOUBLE) FROM events
UNION ALL SELECT 'up', concat('i', user_id % 3), event_id, ts, CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS DOUBLE) FROM events"""


def series(spark, d):
    """All series of the rules; a GET request also stands for an increase of the counter of rate limits, one with status 500 for denials.
    Durations are stretched so that some last longer than the highest threshold."""
    r = fx(spark, d, "fx_requests").withColumn("seconds", F.col("duration_ms") / 25)
    status, path, sec = F.col("status_code"), F.col("path"), F.col("seconds")
    shares = {"error_ratio": status >= 500, "auth_failure_ratio": ~F.coalesce(F.col("raw_key").startswith("ck_"), F.lit(False))}
    rates = {"rate_limited_per_s": F.when(F.col("method") == "GET", F.col("request_id") % 9001), "rbac_denials_per_s": F.when(status == 500, F.col("request_id") % 4001)}
    p95 = {"request_p95": (sec, F.lit(True), C.HTTP_BOUNDS), "publish_p95": (sec, path == "/api/publish", C.HISTOGRAM_BOUNDS),
           "query_p95": (sec, path.endswith("/query"), C.HISTOGRAM_BOUNDS)}
    gauges = spark.sql(SAMPLES.replace("FROM events", f"FROM parquet.`{d}/events.parquet`"))
    return mt.request_series(r, "ts", shares, rates, p95).unionByName(
        mt.gauge_series(gauges, "ts", "id", {"registered_agents": "sum", "memory_bytes": "max", "up": "min"}))


def p95_sql(name, where, bounds="hb"):
    h = hist_sql(f"(SELECT * FROM gr WHERE {where})", "grid", "seconds").split("hh AS ")[1].replace(", hb GROUP", f", {bounds} GROUP")
    return f"""{name}_h AS {h},
{name}_l AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(bucket) OVER w, 0) AS below, 0.95::DOUBLE * count AS rk FROM {name}_h WINDOW w AS (PARTITION BY grid ORDER BY le)),
{name} AS (SELECT '{name}' AS series, grid, arg_min(CASE WHEN isinf(le) THEN lo WHEN bucket = below THEN le ELSE lo + (le - lo) * ((rk - below) / (bucket - below)) END, le) AS value
  FROM {name}_l WHERE bucket >= rk GROUP BY grid)"""


HX = "hx(le) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in C.HTTP_BOUNDS) + ", ('inf'::DOUBLE))"
HB = "hb(le) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in C.HISTOGRAM_BOUNDS) + ", ('inf'::DOUBLE))"
ALERT_SQL = f"""
WITH gr AS (SELECT *, duration_ms / 25 AS seconds, CAST(ceil(epoch_us(ts) / 30000000.0::DOUBLE) AS BIGINT) * 30 + 30 * s AS grid FROM fx_requests, range(10) r(s)),
sa AS ({SAMPLES}),
ga AS (SELECT *, CAST(ceil(epoch_us(ts) / 30000000.0::DOUBLE) AS BIGINT) * 30 + 30 * s AS grid FROM sa, range(10) r(s)
  QUALIFY row_number() OVER (PARTITION BY series, label, grid ORDER BY ts DESC, id DESC) = 1),
{HB}, {HX}, {p95_sql('request_p95', 'true', 'hx')}, {p95_sql('publish_p95', "path = '/api/publish'")}, {p95_sql('query_p95', "path LIKE '%/query'")},
se AS (SELECT 'error_ratio' AS series, grid, count(*) FILTER (status_code >= 500) / count(*) AS value FROM gr GROUP BY 2
  UNION ALL SELECT 'auth_failure_ratio', grid, count(*) FILTER (NOT coalesce(starts_with(raw_key, 'ck_'), false)) / count(*) FROM gr GROUP BY 2
  UNION ALL SELECT 'rate_limited_per_s', grid, coalesce(sum(request_id % 9001) FILTER (method = 'GET'), 0) / 300.0::DOUBLE FROM gr GROUP BY 2
  UNION ALL SELECT 'rbac_denials_per_s', grid, coalesce(sum(request_id % 4001) FILTER (status_code = 500), 0) / 300.0::DOUBLE FROM gr GROUP BY 2
  UNION ALL SELECT * FROM request_p95 UNION ALL SELECT * FROM publish_p95 UNION ALL SELECT * FROM query_p95
  UNION ALL SELECT series, grid, CASE series WHEN 'registered_agents' THEN sum(value) WHEN 'up' THEN min(value) ELSE max(value) END FROM ga GROUP BY 1, 2),
ru(alert, series, op, threshold, hold, severity) AS (VALUES {', '.join(f"('{k}', '{v[0]}', '{v[1]}', {v[2]}::DOUBLE, {v[3]}, '{v[4]}')" for k, v in C.ALERT_RULES.items())}),
hi AS (SELECT alert, severity, hold, grid, value, grid / 30 - row_number() OVER (PARTITION BY alert ORDER BY grid) AS i FROM se JOIN ru ON ru.series = se.series WHERE CASE op WHEN '>' THEN value > threshold ELSE value = threshold END)
SELECT alert, severity, min(grid) AS started, min(grid) + hold AS fires_at, max(grid) AS ended, round(max(value), 6) AS peak FROM hi GROUP BY alert, severity, hold, i HAVING max(grid) - min(grid) >= hold"""


@query("m11_alerts", ALERT_SQL)
def m11(spark, d):
    return mt.alerts(series(spark, d)).withColumn("peak", F.round("peak", 6))


PATHS = """
SELECT event_id AS request_id, CASE event_id % 8 WHEN 0 THEN concat('/api/v1/projects/', user_id, '/data/') WHEN 1 THEN concat('/api/agents/agent-', user_id)
  WHEN 2 THEN '/api/items/123e4567-e89b-12d3-a456-426614174000' WHEN 3 THEN concat('/files/', 'deadbeefdeadbeef', event_id % 10, '/raw') WHEN 4 THEN concat('/u/user-', event_id)
  WHEN 5 THEN '/health' WHEN 6 THEN concat('/api/keys/short', event_id) ELSE '/' END AS path FROM events"""


@query("m13_normalize_endpoint", f"""
WITH p AS ({PATHS}), s AS (SELECT request_id, path, string_split(trim(path, '/'), '/') AS parts FROM p)
SELECT request_id, '/' || array_to_string(list_transform(parts, lambda x: CASE WHEN (length(x) = 36 AND length(x) - length(replace(x, '-', '')) = 4)
  OR regexp_full_match(x, '[0-9a-fA-F_-]{{16,}}') OR regexp_full_match(x, '[0-9]+') OR regexp_matches(x, '^(proj-|agent-|user-|key-|req-|sess-)') THEN '{{id}}' ELSE x END), '/') AS endpoint FROM s""")
def m13(spark, d):
    p = spark.sql(PATHS.replace("FROM events", f"FROM parquet.`{d}/events.parquet`"))
    return p.select("request_id", mt.normalize_endpoint("path").alias("endpoint"))


@query("m14_http_stats", """
WITH n AS (SELECT method, regexp_replace(path, '/[0-9]+(/|$)', '/{id}\\1', 'g') AS endpoint, status_code, duration_ms FROM fx_requests)
SELECT method, endpoint, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors, round(avg(duration_ms), 6) AS mean_ms,
  round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 6) AS p99_ms FROM n GROUP BY 1, 2""")
def m14(spark, d):
    return mt.http_stats(fx(spark, d, "fx_requests"))


@query("m15_latency_summary", """
WITH g AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1)
SELECT event_type, n, mean, (v[CAST(floor((n + 1) / 2) AS BIGINT)] + v[CAST(floor(n / 2) AS BIGINT) + 1]) / 2 AS median,
  v[CAST(floor(0.95::DOUBLE * n) AS BIGINT) + 1] AS p95, v[1] AS min, v[n] AS max FROM g""")
def m15(spark, d):
    return mt.latency_summary(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value")


READINGS = """
SELECT ts, CASE event_type WHEN 'click' THEN 'postgresql' WHEN 'view' THEN 'redis' WHEN 'purchase' THEN 'embedding_model' WHEN 'signup' THEN 'memory' ELSE 'cpu' END AS component,
  CASE WHEN event_id % 101 <> 0 THEN value * CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 6 ELSE 0.5 END END AS value FROM events"""


@query("m16_health_rollup", f"""
WITH r AS ({READINGS}), s AS (SELECT date_trunc('hour', ts) AS hour, component, CASE WHEN value IS NULL THEN 2 WHEN value > CASE component WHEN 'embedding_model' THEN 1000 WHEN 'memory' THEN 2048 WHEN 'cpu' THEN 80 ELSE 100 END THEN 1 ELSE 0 END AS s FROM r)
SELECT hour, CASE max(s) WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' ELSE 'unhealthy' END AS status,
  coalesce(max(s) FILTER (component IN ('postgresql', 'redis', 'embedding_model')), 0) < 2 AS ready FROM s GROUP BY 1""")
def m16(spark, d):
    r = spark.sql(READINGS.replace("FROM events", f"FROM parquet.`{d}/events.parquet`")).withColumn("hour", F.date_trunc("hour", "ts"))
    return mt.health(r, "hour")


def logs(spark, d):
    r = fx(spark, d, "fx_requests")
    line = F.to_json(F.struct(F.concat(F.lit("req-"), F.col("request_id") % 500).alias("request_id"), F.when(F.col("status_code") >= 400, "ERROR").otherwise("INFO").alias("level"),
                              (F.col("duration_ms") * 10).alias("duration_ms"), F.when(F.col("status_code") >= 400, F.concat(F.lit("Http"), "status_code")).alias("error_type"), "project_id",
                              F.col("path").alias("message")))
    return mt.parse_logs(r.select(line.alias("line")), "line")


LOG_SQL = """
lo AS (SELECT 'req-' || (request_id % 500) AS request_id, CASE WHEN status_code >= 400 THEN 'ERROR' ELSE 'INFO' END AS level, duration_ms * 10 AS duration_ms,
  CASE WHEN status_code >= 400 THEN 'Http' || status_code END AS error_type, project_id, path AS message FROM fx_requests)"""


@query("m17_log_errors", f"WITH {LOG_SQL} SELECT request_id, error_type, message FROM lo WHERE level = 'ERROR' AND request_id IN (SELECT 'req-' || c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')")
def m17(spark, d):
    ids = spark.read.parquet(f"{d}/customer.parquet").filter("c_mktsegment = 'HOUSEHOLD'").select(F.concat(F.lit("req-"), F.col("c_custkey")).alias("request_id"))
    return mt.log_errors(logs(spark, d), ids).select("request_id", "error_type", "message")


@query("m17_slow_requests", f"WITH {LOG_SQL} SELECT request_id, duration_ms FROM lo WHERE duration_ms > 1000")
def m17s(spark, d):
    return mt.slow_requests(logs(spark, d)).select("request_id", "duration_ms")


@query("m17_errors_by_type", f"WITH {LOG_SQL} SELECT error_type, count(*) AS errors FROM lo WHERE level = 'ERROR' GROUP BY 1")
def m17t(spark, d):
    return mt.errors_by_type(logs(spark, d))


@query("m17_project_logs", f"WITH {LOG_SQL} SELECT request_id, level, message FROM lo WHERE project_id = 'proj_3'")
def m17p(spark, d):
    return mt.project_logs(logs(spark, d), "proj_3").select("request_id", "level", "message")


REPORTS = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ConnectionResetError' WHEN 1 THEN 'BrokenPipeError' WHEN 2 THEN 'ValueError' END AS error_type,
  CASE WHEN event_id % 7 = 0 THEN 'GET /health' WHEN event_id % 7 = 1 THEN '/metrics' ELSE concat('/api/', event_type) END AS transaction,
  concat('Bearer ', user_id) AS auth, concat('10.0.0.', user_id % 200) AS ip, event_type AS agent,
  CASE WHEN event_id % 5 = 0 THEN concat('API_KEY=', user_id) WHEN event_id % 5 = 1 THEN 'q=1' END AS query_string FROM events"""


@query("m18_redact", f"""
WITH r AS ({REPORTS})
SELECT event_id, '[Filtered]' AS auth, '[Filtered]' AS ip, agent, CASE WHEN contains(lower(query_string), 'api_key') THEN '[Filtered]' ELSE query_string END AS query_string
FROM r WHERE coalesce(error_type NOT IN ('ConnectionResetError', 'BrokenPipeError'), true) AND NOT (contains(transaction, '/health') OR contains(transaction, '/metrics'))""")
def m18(spark, d):
    r = spark.sql(REPORTS.replace("FROM events", f"FROM parquet.`{d}/events.parquet`"))
    r = r.withColumn("headers", F.create_map(F.lit("Authorization"), "auth", F.lit("X-Forwarded-For"), "ip", F.lit("User-Agent"), "agent"))
    return mt.redact(r).select("event_id", F.col("headers")["Authorization"].alias("auth"), F.col("headers")["X-Forwarded-For"].alias("ip"),
                               F.col("headers")["User-Agent"].alias("agent"), "query_string")


@query("m19_slo_status", """
WITH m AS (SELECT project_id, 'error_rate' AS metric, round(count(*) FILTER (status_code >= 500) / count(*), 6) AS value FROM fx_requests GROUP BY 1
  UNION ALL SELECT project_id, 'p99_latency_ms', round(quantile_cont(duration_ms * 4, 0.99), 6) FROM fx_requests GROUP BY 1)
SELECT *, CASE WHEN metric = 'error_rate' THEN CASE WHEN value > 0.01 THEN 'critical' WHEN value > 0.001 THEN 'warning' ELSE 'ok' END
  ELSE CASE WHEN value > 2000 THEN 'critical' WHEN value > 500 THEN 'warning' ELSE 'ok' END END AS status FROM m""")
def m19(spark, d):
    from ..plans.skew import exact_percentiles
    r = fx(spark, d, "fx_requests").withColumn("ms", F.col("duration_ms") * 4)
    err = mt.ratio(r, F.col("status_code") >= 500, F.lit(True), ["project_id"]).select(
        "project_id", F.lit("error_rate").alias("metric"), F.round("ratio", 6).alias("value"))
    p99 = exact_percentiles(r.select("project_id", "ms"), ["project_id"], "ms", {"p": 0.99}).select(
        "project_id", F.lit("p99_latency_ms").alias("metric"), F.round("p", 6).alias("value"))
    return mt.slo_status(err.unionByName(p99))
