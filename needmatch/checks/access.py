"""Access decision queries."""

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import access as ac
from .fixtures import NOW, fx
from .registry import query

DAY = 86400
now = lambda: F.lit(NOW).cast("timestamp_ntz")


def keys(spark, d):
    return fx(spark, d, "fx_keys").withColumn("key_hash", F.sha2("raw_key", 256))


AUTH_SQL = """
au AS (SELECT r.*, k.key_id, k.role, k.only_project, CASE WHEN r.raw_key IS NULL THEN 'missing_key' WHEN NOT starts_with(r.raw_key, 'ck_') THEN 'invalid_format'
   WHEN k.key_id IS NULL THEN 'unknown_key' END AS failure FROM fx_requests r LEFT JOIN fx_keys k ON k.raw_key = r.raw_key)"""


def authed(spark, d):
    return ac.authenticate(fx(spark, d, "fx_requests"), keys(spark, d))


@query("k1_authenticate", f"WITH {AUTH_SQL} SELECT request_id, key_id, failure FROM au")
def k1(spark, d):
    return authed(spark, d).select("request_id", "key_id", "failure")


SA_SQL = f"""
sa AS (SELECT r.request_id, r.ts, a.account_id, a.key_id, CASE WHEN NOT starts_with(r.raw_key, 'sak_') THEN 'invalid_format' WHEN a.account_id IS NULL THEN 'unknown_key'
   WHEN NOT a.is_active THEN 'inactive_account' WHEN NOT a.key_listed THEN 'key_not_listed' WHEN a.expires_on < DATE '2024-01-25' THEN 'expired' END AS failure
   FROM fx_sa_requests r LEFT JOIN fx_accounts a ON a.raw_key = r.raw_key)"""


def sa(spark, d):
    acc = fx(spark, d, "fx_accounts")
    accounts = acc.select("account_id", "is_active", F.filter(F.array(F.when(F.col("key_listed"), F.struct(
        "key_id", F.col("expires_on").alias("expires_at")))), lambda k: k.isNotNull()).alias("keys"))
    hashes = acc.select(F.sha2("raw_key", 256).alias("key_hash"), "account_id", "key_id")
    return ac.authenticate_sa(fx(spark, d, "fx_sa_requests"), accounts, hashes, F.lit("2024-01-25").cast("date"))


@query("k2_authenticate_sa", f"WITH {SA_SQL} SELECT request_id, account_id, failure FROM sa")
def k2(spark, d):
    return sa(spark, d).select("request_id", "account_id", "failure")


@query("k3_sa_usage", f"""
WITH {SA_SQL} SELECT account_id, max(ts) AS last_active, count(*) AS total_requests FROM sa WHERE failure IS NULL GROUP BY 1""")
def k3(spark, d):
    return ac.sa_usage(sa(spark, d))[0]


@query("k3_sa_key_usage", f"WITH {SA_SQL} SELECT account_id, key_id, max(ts) AS last_used FROM sa WHERE failure IS NULL GROUP BY 1, 2")
def k3k(spark, d):
    return ac.sa_usage(sa(spark, d))[1]


# request paths that reach every rule
CALLS = """
SELECT event_id AS request_id, concat('key_', user_id % 110) AS key_id,
  CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'DELETE' ELSE 'PUT' END AS method,
  CASE user_id % 13 WHEN 0 THEN '/api/agents' WHEN 1 THEN concat('/api/agents/a', event_id) WHEN 2 THEN '/api/auth/keys' WHEN 3 THEN concat('/api/auth/keys/', event_id)
    WHEN 4 THEN '/api/data/publish' WHEN 5 THEN '/api/agents/register' WHEN 6 THEN '/api/query' WHEN 7 THEN concat('/api/projects/proj_', event_id % 20, '/query')
    WHEN 8 THEN concat('/api/projects/proj_', event_id % 20, '/data') WHEN 9 THEN concat('/api/projects/proj_', event_id % 20, '/events') WHEN 10 THEN '/api/admin/rate-limits'
    WHEN 11 THEN '/api/admin/retention/x' ELSE '/health' END AS path,
  CASE WHEN event_id % 3 = 0 THEN concat('{"project_id": "proj_', user_id % 20, '"}') ELSE '{}' END AS body
FROM events"""


def calls(spark, d):
    c = spark.sql(CALLS.replace("FROM events", f"FROM parquet.`{d}/events.parquet`"))
    return (c.withColumn("permission", ac.required_permission("method", "path"))
            .withColumn("project_id", ac.project_of_request("path", "body")))


def rule_sql():
    out = []
    for method, pattern, permission in C.PERMISSION_RULES:
        test = f"path LIKE '{pattern.replace('_', '!_').replace('*', '%')}%' ESCAPE '!'"
        out.append(f"WHEN {'' if method is None else f'method = {chr(39)}{method}{chr(39)} AND '}{test} THEN '{permission}'")
    return "CASE " + " ".join(out) + " END"


PERM_SQL = f"""
ca AS ({CALLS}),
pe AS (SELECT *, {rule_sql()} AS permission, coalesce(nullif(regexp_extract(path, '/projects/([^/]+)', 1), ''), json_extract_string(body, '$.project_id')) AS project_id FROM ca),
roles(role, permission) AS (VALUES {', '.join(f"('{r}', '{p}')" for r, ps in C.ROLE_PERMISSIONS.items() for p in ps)}),
de AS (SELECT pe.*, coalesce(k.role, 'readonly') AS role, pe.permission IS NULL OR (EXISTS (SELECT 1 FROM roles WHERE roles.role = coalesce(k.role, 'readonly') AND roles.permission = pe.permission)
  AND (k.only_project IS NULL OR pe.project_id IS NULL OR k.only_project = pe.project_id)) AS allowed FROM pe LEFT JOIN fx_keys k ON k.key_id = pe.key_id)"""


def decisions(spark, d):
    roles = fx(spark, d, "fx_keys").select("key_id", "role", F.filter(F.array("only_project"), lambda p: p.isNotNull()).alias("projects"))
    return ac.authorize(calls(spark, d), roles)


@query("k4_required_permission", f"WITH {PERM_SQL} SELECT request_id, permission FROM pe")
def k4(spark, d):
    return calls(spark, d).select("request_id", "permission")


@query("k5_project_of_request", f"WITH {PERM_SQL} SELECT request_id, project_id FROM pe")
def k5(spark, d):
    return calls(spark, d).select("request_id", "project_id")


@query("k6_authorize", f"WITH {PERM_SQL} SELECT request_id, role, permission, allowed FROM de")
def k6(spark, d):
    return decisions(spark, d).select("request_id", "role", "permission", "allowed")


@query("k7_denials", f"WITH {PERM_SQL} SELECT role, permission, count(*) AS denials FROM de WHERE NOT allowed GROUP BY 1, 2")
def k7(spark, d):
    return ac.denials(decisions(spark, d))


@query("k8_rate_key", """
SELECT request_id, coalesce(raw_key, 'anonymous') || ':' || path || ':' || project_id AS rate_key,
  CASE WHEN path IN ('/health', '/', '/docs', '/openapi.json', '/redoc') THEN NULL WHEN starts_with(path, '/api/publish') THEN 100 WHEN starts_with(path, '/api/register') THEN 50
    WHEN starts_with(path, '/api/query') THEN 200 WHEN starts_with(path, '/auth/') OR starts_with(path, '/admin/') THEN 20 ELSE 60 END AS max_requests FROM fx_requests""")
def k8(spark, d):
    return fx(spark, d, "fx_requests").select("request_id", ac.rate_key("raw_key", "path", F.col("project_id")).alias("rate_key"),
                                              ac.rate_rule("path").alias("max_requests"))


LIMIT_SQL = """
WITH RECURSIVE s AS (SELECT project_id AS rate_key, request_id, ts, row_number() OVER (PARTITION BY project_id ORDER BY ts, request_id) AS rn FROM fx_requests),
f AS (SELECT rate_key, request_id, ts, rn, [ts] AS acc, true AS allowed, 0 AS counted FROM s WHERE rn = 1
  UNION ALL SELECT s.rate_key, s.request_id, s.ts, s.rn,
    CASE WHEN len(list_filter(f.acc, lambda a: a >= s.ts - INTERVAL 1 DAY)) < 10 THEN list_append(list_filter(f.acc, lambda a: a >= s.ts - INTERVAL 1 DAY), s.ts)
      ELSE list_filter(f.acc, lambda a: a >= s.ts - INTERVAL 1 DAY) END,
    len(list_filter(f.acc, lambda a: a >= s.ts - INTERVAL 1 DAY)) < 10, len(list_filter(f.acc, lambda a: a >= s.ts - INTERVAL 1 DAY))
  FROM f JOIN s ON s.rate_key = f.rate_key AND s.rn = f.rn + 1)
SELECT rate_key, request_id, allowed, CAST(greatest(10 - counted - CASE WHEN allowed THEN 1 ELSE 0 END, 0) AS BIGINT) AS remaining,
  CAST(floor(epoch(ts) + 86400) AS BIGINT) AS reset, CASE WHEN NOT allowed THEN CAST(86400 AS BIGINT) END AS retry_after FROM f"""


@query("k9_rate_limit", LIMIT_SQL)
def k9(spark, d):
    return ac.rate_limit(fx(spark, d, "fx_requests"), "project_id", "request_id", "ts", 10, DAY)


@query("k11_rate_status", f"""
WITH u AS (SELECT raw_key, path AS endpoint, count(*) AS used FROM fx_requests WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY AND ts <= TIMESTAMP '{NOW}' GROUP BY 1, 2),
g AS (SELECT raw_key, e.endpoint, e.lim FROM (SELECT DISTINCT raw_key FROM fx_requests WHERE raw_key IS NOT NULL),
  (VALUES ('/api/publish', 100), ('/api/register', 50), ('/api/query', 200), ('/auth/', 20), ('/admin/', 20)) e(endpoint, lim))
SELECT g.raw_key, g.endpoint, coalesce(used, 0) AS used, CAST(greatest(lim - coalesce(used, 0), 0) AS BIGINT) AS remaining, greatest(lim - coalesce(used, 0), 0) > 0 AS allowed
FROM g LEFT JOIN u ON u.raw_key = g.raw_key AND u.endpoint = g.endpoint""")
def k11(spark, d):
    return ac.rate_status(fx(spark, d, "fx_requests"), now(), 10 * DAY)


@query("k12_rate_pressure", """
SELECT project_id AS rate_key, request_id, count(*) OVER (PARTITION BY project_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM fx_requests""")
def k12(spark, d):
    return ac.rate_pressure(fx(spark, d, "fx_requests"), "project_id", "request_id", "ts", 6 * 3600)
