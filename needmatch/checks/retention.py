"""Retention queries."""

from pyspark.sql import functions as F

from ..operators import retention as rt
from .fixtures import NOW, fx
from .registry import query

now = lambda: F.lit(NOW).cast("timestamp_ntz")
CUT = f"TIMESTAMP '{NOW}' - INTERVAL 12 DAY"


@query("t1_expire_by_age", f"SELECT id, project_id FROM fx_log WHERE created_at >= {CUT}")
def t1(spark, d):
    return rt.expire_by_age(fx(spark, d, "fx_log"), now(), 12).select("id", "project_id")


@query("t1_expired_counts", f"SELECT project_id, count(*) AS deleted FROM fx_log WHERE created_at < {CUT} GROUP BY 1")
def t1c(spark, d):
    return rt.expired_counts(fx(spark, d, "fx_log"), now(), 12)


@query("t2_trim_to_count", """
SELECT id, project_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY sequence DESC) AS rn FROM fx_log) WHERE rn <= 200""")
def t2(spark, d):
    return rt.trim_to_count(fx(spark, d, "fx_log"), 200).select("id", "project_id", "sequence")


@query("t3_expire_agents", f"SELECT agent_id, last_seen FROM fx_agents WHERE last_seen IS NULL OR last_seen >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def t3(spark, d):
    return rt.expire_agents(fx(spark, d, "fx_agents"), now()).select("agent_id", "last_seen")


@query("t4_cleanup", f"""
SELECT id, project_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY sequence DESC) AS rn FROM fx_log WHERE created_at >= {CUT}) WHERE rn <= 150""")
def t4(spark, d):
    return rt.cleanup(fx(spark, d, "fx_log"), fx(spark, d, "fx_agents"), now(), 12, 150)[0].select("id", "project_id")


@query("t4_cleanup_stats", f"""
WITH c AS (SELECT project_id, count(*) FILTER (created_at < {CUT}) AS expired, count(*) FILTER (created_at >= {CUT}) AS young FROM fx_log GROUP BY 1)
SELECT project_id, expired, greatest(young - 150, 0) AS trimmed, least(young, 150) AS kept FROM c""")
def t4s(spark, d):
    return rt.cleanup(fx(spark, d, "fx_log"), fx(spark, d, "fx_agents"), now(), 12, 150)[2]


@query("t4_cleanup_agents", f"SELECT count(*) FILTER (last_seen < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS agents_removed FROM fx_agents")
def t4a(spark, d):
    return rt.cleanup(fx(spark, d, "fx_log"), fx(spark, d, "fx_agents"), now(), 12, 150)[3]


@query("t5_retention_stats", "SELECT project_id, count(*) AS events, min(created_at) AS oldest, max(created_at) AS newest FROM fx_log GROUP BY 1")
def t5(spark, d):
    return rt.retention_stats(fx(spark, d, "fx_log"))
