"""Tenant and quota queries."""

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import tenancy as tn
from .fixtures import fx
from .registry import query

CUSTOM = {"max_events_per_month": "custom_max_events"}


def quota_sql(name):
    i = C.QUOTA_COLUMNS.index(name)
    v = lambda x: str(x).lower() if isinstance(x, bool) else f"{x}::BIGINT"
    case = "CASE plan " + " ".join(f"WHEN '{p}' THEN {v(q[i])}" for p, q in C.PLAN_QUOTAS.items()) + f" ELSE {v(C.DEFAULT_QUOTAS[i])} END"
    return f"coalesce(custom_max_events, {case}) AS {name}" if name == "max_events_per_month" else f"{case} AS {name}"


QUOTA_SQL = f"q AS (SELECT *, {', '.join(quota_sql(n) for n in C.QUOTA_COLUMNS)} FROM fx_tenants)"
USAGE_SQL = """
ev AS (SELECT tenant_id, count(DISTINCT project_id) AS projects_count, count(*) FILTER (date_trunc('month', created_at) = TIMESTAMP '2024-01-01') AS events_this_month,
   round(sum(strlen(data)) / 1048576, 6) AS storage_used_mb FROM fx_log GROUP BY 1),
ag AS (SELECT tenant_id, count(*) AS agents_count FROM fx_agents GROUP BY 1), ke AS (SELECT tenant_id, count(*) AS api_keys_count FROM fx_keys GROUP BY 1),
us AS (SELECT ev.tenant_id, projects_count, coalesce(agents_count, 0) AS agents_count, coalesce(api_keys_count, 0) AS api_keys_count, events_this_month, storage_used_mb
   FROM ev LEFT JOIN ag ON ag.tenant_id = ev.tenant_id LEFT JOIN ke ON ke.tenant_id = ev.tenant_id)"""


def quotas(spark, d):
    return tn.quotas(fx(spark, d, "fx_tenants"), CUSTOM)


def usage(spark, d):
    return tn.tenant_usage(*(fx(spark, d, n) for n in ("fx_log", "fx_agents", "fx_keys")), F.lit("2024-01-01").cast("timestamp_ntz"))


@query("h1_plan_quotas", f"WITH {QUOTA_SQL} SELECT tenant_id, plan, {', '.join(C.QUOTA_COLUMNS)} FROM q")
def h1(spark, d):
    return quotas(spark, d).select("tenant_id", "plan", *C.QUOTA_COLUMNS)


@query("h2_tenant_usage", f"WITH {USAGE_SQL} SELECT * FROM us")
def h2(spark, d):
    return usage(spark, d)


@query("h3_usage_percent", f"""
WITH {QUOTA_SQL}, {USAGE_SQL}
SELECT us.tenant_id, 'projects' AS resource, round(projects_count / max_projects * 100, 4) AS percent FROM us JOIN q ON q.tenant_id = us.tenant_id
UNION ALL SELECT us.tenant_id, 'api_keys', round(api_keys_count / max_api_keys * 100, 4) FROM us JOIN q ON q.tenant_id = us.tenant_id
UNION ALL SELECT us.tenant_id, 'events', round(events_this_month / max_events_per_month * 100, 4) FROM us JOIN q ON q.tenant_id = us.tenant_id
UNION ALL SELECT us.tenant_id, 'storage', round(storage_used_mb / max_storage_mb * 100, 4) FROM us JOIN q ON q.tenant_id = us.tenant_id""")
def h3(spark, d):
    return tn.usage_percent(usage(spark, d), quotas(spark, d).drop("plan", "name"))


REQUESTS = """
SELECT event_id AS request_id, CASE WHEN user_id % 8 = 7 THEN 'tenant_x' ELSE concat('tenant_', user_id % 8) END AS tenant_id,
  CASE event_type WHEN 'click' THEN 'events' WHEN 'view' THEN 'projects' WHEN 'purchase' THEN 'storage' WHEN 'signup' THEN 'agents' ELSE 'widgets' END AS resource,
  event_id % 3 + 1 AS amount FROM events"""


@query("h4_check_quota", f"""
WITH {QUOTA_SQL}, {USAGE_SQL}, r AS ({REQUESTS}),
j AS (SELECT r.*, q.is_active, us.projects_count,
  CASE resource WHEN 'projects' THEN projects_count + amount WHEN 'agents' THEN agents_count + amount WHEN 'events' THEN events_this_month + amount WHEN 'storage' THEN storage_used_mb + amount END AS cur,
  CASE resource WHEN 'projects' THEN (projects_count + amount)::VARCHAR WHEN 'agents' THEN (agents_count + amount)::VARCHAR WHEN 'events' THEN (events_this_month + amount)::VARCHAR
    WHEN 'storage' THEN (storage_used_mb + amount)::VARCHAR END AS txt,
  CASE resource WHEN 'projects' THEN max_projects WHEN 'agents' THEN max_agents_per_project * max_projects WHEN 'events' THEN max_events_per_month WHEN 'storage' THEN max_storage_mb END AS lim
  FROM r LEFT JOIN q ON q.tenant_id = r.tenant_id LEFT JOIN us ON us.tenant_id = r.tenant_id),
m AS (SELECT request_id, tenant_id, resource, amount, CASE WHEN is_active IS NULL THEN 'Tenant ''' || tenant_id || ''' not found'
  WHEN NOT is_active THEN 'Tenant ''' || tenant_id || ''' is inactive' WHEN projects_count IS NULL THEN 'Usage data not found for tenant ''' || tenant_id || ''''
  WHEN resource = 'widgets' THEN 'Unknown resource' WHEN cur > lim THEN 'Quota exceeded: ' || resource || ' (' || txt || '/' || lim || ')' ELSE 'OK' END AS message FROM j)
SELECT *, message IN ('OK', 'Unknown resource') AS allowed FROM m""")
def h4(spark, d):
    r = spark.sql(REQUESTS.replace("FROM events", f"FROM parquet.`{d}/events.parquet`"))
    return tn.check_quota(r, quotas(spark, d), usage(spark, d))


@query("h5_quota_running", f"""
WITH {QUOTA_SQL}, n AS (SELECT id, tenant_id, date_trunc('month', created_at) AS month, row_number() OVER (PARTITION BY tenant_id, date_trunc('month', created_at) ORDER BY id) AS position FROM fx_log)
SELECT n.id, n.tenant_id, n.month, n.position, coalesce(n.position <= q.max_events_per_month, false) AS accepted FROM n LEFT JOIN q ON q.tenant_id = n.tenant_id""")
def h5(spark, d):
    return tn.quota_running(fx(spark, d, "fx_log"), quotas(spark, d))


@query("h6_list_tenants", "SELECT tenant_id, plan, created_on FROM fx_tenants WHERE plan = 'pro' AND is_active ORDER BY created_on DESC, tenant_id LIMIT 50 OFFSET 10")
def h6(spark, d):
    return tn.list_tenants(fx(spark, d, "fx_tenants"), "pro", True, 50, 10).select("tenant_id", "plan", "created_on")


@query("h7_tenants_by_plan", """
WITH c AS (SELECT plan, is_active, count(*) AS n FROM fx_tenants GROUP BY 1, 2
  UNION ALL SELECT unnest(['free', 'free', 'starter', 'starter', 'pro', 'pro', 'enterprise', 'enterprise']), unnest([true, false, true, false, true, false, true, false]), 0)
SELECT plan, is_active, CAST(sum(n) AS BIGINT) AS tenants FROM c GROUP BY 1, 2""")
def h7(spark, d):
    return tn.tenants_by_plan(fx(spark, d, "fx_tenants"))


CALLS = """
SELECT event_id AS request_id, CASE WHEN event_id % 10 = 0 THEN concat('tenant_h', event_id % 3) WHEN event_id % 10 = 1 THEN '' END AS header_tenant,
  concat('key_', user_id) AS key_id, CASE WHEN event_id % 2 = 0 THEN concat('/t/acme', user_id % 9, '/api/v1/query') ELSE '/api/v1/query' END AS path FROM events"""


@query("h8_resolve_tenant", f"""
WITH r AS ({CALLS})
SELECT r.request_id, coalesce(nullif(header_tenant, ''), k.tenant_id, nullif(regexp_extract(path, '^/t/([^/]*)', 1), '')) AS tenant_id
FROM r LEFT JOIN fx_keys k ON k.key_id = r.key_id""")
def h8(spark, d):
    r = spark.sql(CALLS.replace("FROM events", f"FROM parquet.`{d}/events.parquet`"))
    return tn.resolve_tenant(r, fx(spark, d, "fx_keys")).select("request_id", "tenant_id")


@query("h9_tenant_key", """
WITH k AS (SELECT id, CASE WHEN id % 10 = 3 THEN tenant_id || ':thing:' || project_id WHEN id % 10 = 4 THEN tenant_id ELSE tenant_id || ':project:' || project_id || CASE WHEN id % 10 = 5 THEN ':x' ELSE '' END END AS key,
  id % 10 NOT IN (3, 4) AS ok, tenant_id, project_id || CASE WHEN id % 10 = 5 THEN ':x' ELSE '' END AS project_id FROM fx_log)
SELECT id, key, CASE WHEN ok THEN tenant_id END AS tenant_id, CASE WHEN ok THEN project_id END AS project_id FROM k""")
def h9(spark, d):
    m = F.col("id") % 10
    key = (F.when(m == 3, F.concat("tenant_id", F.lit(":thing:"), "project_id")).when(m == 4, F.col("tenant_id"))
           .when(m == 5, F.concat(tn.tenant_key("tenant_id", "project_id"), F.lit(":x"))).otherwise(tn.tenant_key("tenant_id", "project_id")))
    return fx(spark, d, "fx_log").select("id", key.alias("key")).select("id", "key", F.inline(F.array(tn.parse_tenant_key("key"))))


@query("h10_project_listing", "SELECT DISTINCT tenant_id, project_id FROM fx_log")
def h10(spark, d):
    return tn.project_listing(fx(spark, d, "fx_log"))
