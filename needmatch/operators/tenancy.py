"""Tenants, plans, usage and quota decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..plans.skew import id_slice, sliced_row_number


def plan_quota(plan: str | Column, name: str) -> Column:
    """Quota of a plan; plans that are not known get the defaults."""
    p = F.col(plan) if isinstance(plan, str) else plan
    at = C.QUOTA_COLUMNS.index(name)
    start = F.when(F.lit(False), F.lit(C.DEFAULT_QUOTAS[at]))
    return reduce(lambda acc, kv: acc.when(p == kv[0], F.lit(kv[1][at])), C.PLAN_QUOTAS.items(), start).otherwise(
        F.lit(C.DEFAULT_QUOTAS[at]))


def quotas(tenants: DataFrame, custom: dict[str, str] | None = None) -> DataFrame:
    """Tenants with all quota columns; ``custom`` maps a quota to the tenant column overriding it."""
    custom = custom or {}
    for name in C.QUOTA_COLUMNS:
        value = plan_quota("plan", name)
        if name != "webhook_enabled":
            value = value.cast("bigint")
        if name in custom:
            value = F.coalesce(F.col(custom[name]), value)
        tenants = tenants.withColumn(name, value)
    return tenants


def tenant_usage(log: DataFrame, agents: DataFrame, keys: DataFrame, month_start: Column) -> DataFrame:
    """Usage per tenant from the fact tables, each aggregated before the joins."""
    in_month = F.date_trunc("month", "created_at") == month_start
    by_project = log.groupBy("tenant_id", "project_id").agg(
        F.count_if(in_month).alias("_e"), F.sum(F.octet_length("data")).alias("_b"))
    events = by_project.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("projects_count"), F.sum("_e").alias("events_this_month"),
        F.round(F.sum("_b") / 1048576, 6).alias("storage_used_mb"))
    count = lambda df, name: df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(name))
    joined = (events.join(count(agents, "agents_count"), "tenant_id", "full")
              .join(count(keys, "api_keys_count"), "tenant_id", "full"))
    zero = lambda c, v=0: F.coalesce(c, F.lit(v)).alias(c)
    return joined.select("tenant_id", zero("projects_count"), zero("agents_count"), zero("api_keys_count"),
                         zero("events_this_month"), zero("storage_used_mb", 0.0))


def usage_percent(usage: DataFrame, quota: DataFrame) -> DataFrame:
    """(tenant_id, resource, percent): used / limit * 100, 0 without a limit."""
    joined = usage.join(quota, "tenant_id")
    pct = lambda used, limit: F.when(F.col(limit) > 0, F.round(F.col(used) / F.col(limit) * 100, 4)).otherwise(F.lit(0.0))
    pairs = {"projects": ("projects_count", "max_projects"), "api_keys": ("api_keys_count", "max_api_keys"),
             "events": ("events_this_month", "max_events_per_month"), "storage": ("storage_used_mb", "max_storage_mb")}
    return joined.select("tenant_id", F.inline(F.array(*[
        F.struct(F.lit(r).alias("resource"), pct(*p).alias("percent")) for r, p in pairs.items()])))


def check_quota(requests: DataFrame, tenants: DataFrame, usage: DataFrame) -> DataFrame:
    """Decision and message for (tenant_id, resource, amount) requests; tenants carry quotas."""
    t = tenants.select("tenant_id", "is_active", "max_projects", "max_agents_per_project", "max_api_keys",
                       "max_events_per_month", "max_storage_mb")
    j = requests.join(t, "tenant_id", "left").join(usage, "tenant_id", "left")
    r = F.col("resource")
    used = {"projects": "projects_count", "agents": "agents_count", "api_keys": "api_keys_count",
            "events": "events_this_month", "storage": "storage_used_mb"}
    limit = {"projects": F.col("max_projects"), "agents": F.col("max_agents_per_project") * F.col("max_projects"),
             "api_keys": F.col("max_api_keys"), "events": F.col("max_events_per_month"), "storage": F.col("max_storage_mb")}
    pick = lambda of: reduce(lambda acc, n: acc.when(r == n, of(n)), C.QUOTA_RESOURCES[1:],
                             F.when(r == C.QUOTA_RESOURCES[0], of(C.QUOTA_RESOURCES[0])))
    j = (j.withColumn("_now", pick(lambda n: (F.col(used[n]) + F.col("amount")).cast("double")))
         .withColumn("_text", pick(lambda n: (F.col(used[n]) + F.col("amount")).cast("string")))
         .withColumn("_limit", pick(lambda n: limit[n])))
    about = lambda a, b: F.concat(F.lit(a), F.col("tenant_id"), F.lit(b))
    message = (F.when(F.col("is_active").isNull(), about("Tenant '", "' not found"))
               .when(~F.col("is_active"), about("Tenant '", "' is inactive"))
               .when(F.col("projects_count").isNull(), about("Usage data not found for tenant '", "'"))
               .when(~r.isin(C.QUOTA_RESOURCES), F.lit("Unknown resource"))
               .when(F.col("_now") > F.col("_limit"), F.concat(
                   F.lit("Quota exceeded: "), r, F.lit(" ("), "_text", F.lit("/"), F.col("_limit").cast("string"), F.lit(")")))
               .otherwise(F.lit("OK")))
    return (j.withColumn("message", message)
            .withColumn("allowed", F.col("message").isin("OK", "Unknown resource"))
            .select(*requests.columns, "allowed", "message"))


def quota_running(log: DataFrame, quota: DataFrame) -> DataFrame:
    """Decision per event: the first max_events_per_month of a tenant and month are accepted."""
    rows = log.select("id", "tenant_id", F.date_trunc("month", "created_at").alias("month"))
    numbered = sliced_row_number(rows, ["tenant_id", "month"], id_slice("id"), ["id"], "position")
    return (numbered.join(quota.select("tenant_id", "max_events_per_month"), "tenant_id", "left")
            .withColumn("accepted", F.coalesce(F.col("position") <= F.col("max_events_per_month"), F.lit(False)))
            .drop("max_events_per_month"))


def list_tenants(tenants: DataFrame, plan: str | None = None, is_active: bool | None = None,
                 limit: int = 100, offset: int = 0) -> DataFrame:
    if plan is not None:
        tenants = tenants.filter(F.col("plan") == plan)
    if is_active is not None:
        tenants = tenants.filter(F.col("is_active") == is_active)
    return tenants.orderBy(F.col("created_on").desc(), "tenant_id").offset(offset).limit(limit)


def tenants_by_plan(tenants: DataFrame) -> DataFrame:
    """Counts by plan and state with zeros for the known plans."""
    domain = tenants.sparkSession.createDataFrame(
        [(p, a) for p in C.PLAN_QUOTAS for a in (True, False)], "plan string, is_active boolean")
    counted = tenants.groupBy("plan", "is_active").agg(F.count(F.lit(1)).alias("tenants"))
    return (counted.unionByName(domain.withColumn("tenants", F.lit(0).cast("bigint")))
            .groupBy("plan", "is_active").agg(F.sum("tenants").alias("tenants")))


def resolve_tenant(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Header, else the tenant of the key, else the /t/{id}/ path prefix."""
    of_key = keys.select("key_id", F.col("tenant_id").alias("_key_tenant"))
    in_path = F.nullif(F.regexp_extract("path", r"^/t/([^/]*)", 1), F.lit(""))
    return (requests.join(of_key, "key_id", "left")
            .withColumn("tenant_id", F.coalesce(F.nullif("header_tenant", F.lit("")), "_key_tenant", in_path))
            .drop("_key_tenant"))


def tenant_key(tenant: str | Column, project: str | Column) -> Column:
    return F.concat(tenant, F.lit(":project:"), project)


def parse_tenant_key(key: str | Column) -> Column:
    """struct(tenant_id, project_id), nulls when the key has another shape."""
    p = F.split(key, ":", 3)
    ok = (F.size(p) == 3) & (F.get(p, F.lit(1)) == "project")
    return F.struct(F.when(ok, F.get(p, F.lit(0))).alias("tenant_id"), F.when(ok, F.get(p, F.lit(2))).alias("project_id"))


def project_listing(log: DataFrame) -> DataFrame:
    return log.select("tenant_id", "project_id").distinct()
