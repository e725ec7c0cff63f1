"""Audit queries."""

from pyspark.sql import functions as F

from ..operators import audit as au
from .fixtures import NOW, fx
from .registry import query

now = lambda: F.lit(NOW).cast("timestamp_ntz")
ts = lambda s: F.lit(s).cast("timestamp_ntz")


@query("a1_audit_query", """
SELECT event_id, timestamp, actor_id, event_type, severity, result FROM fx_audit
WHERE tenant_id = 'tenant_2' AND event_type = 'data.updated' AND timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp <= TIMESTAMP '2024-01-28 00:00:00'
ORDER BY timestamp DESC, event_id DESC LIMIT 100 OFFSET 20""")
def a1(spark, d):
    return au.audit_query(fx(spark, d, "fx_audit"), offset=20, tenant="tenant_2", event_type="data.updated",
                          start=ts("2024-01-03 00:00:00"), end=ts("2024-01-28 00:00:00")).select(
        "event_id", "timestamp", "actor_id", "event_type", "severity", "result")


@query("a2_audit_get", "SELECT event_id, event_type, actor_id FROM fx_audit WHERE event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def a2(spark, d):
    ids = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return au.audit_get(fx(spark, d, "fx_audit"), ids).select("event_id", "event_type", "actor_id")


@query("a3_audit_export", f"""
SELECT event_id, timestamp, event_type FROM fx_audit WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY AND timestamp <= TIMESTAMP '{NOW}'
ORDER BY timestamp DESC, event_id DESC""")
def a3(spark, d):
    return au.audit_export(fx(spark, d, "fx_audit"), now(), 20).select("event_id", "timestamp", "event_type")


@query("a4_audit_summary", f"""
WITH r AS (SELECT * FROM fx_audit WHERE tenant_id = 'tenant_1' AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND timestamp <= TIMESTAMP '{NOW}'),
c AS (SELECT 'event_type' AS dimension, event_type AS value, count(*) AS events FROM r GROUP BY 2
  UNION ALL SELECT 'severity', severity, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'result', result, count(*) FROM r GROUP BY 2
  UNION ALL SELECT 'severity', unnest(['info', 'warning', 'error', 'critical']), 0 UNION ALL SELECT 'result', unnest(['success', 'failure', 'partial']), 0)
SELECT dimension, value, CAST(sum(events) AS BIGINT) AS events FROM c GROUP BY 1, 2""")
def a4(spark, d):
    return au.audit_summary(fx(spark, d, "fx_audit"), now(), 14, tenant="tenant_1")


@query("a5_audit_diff", """
WITH f AS (SELECT event_id, unnest(['theme', 'limit', 'mode']) AS field, before_state, after_state FROM fx_audit),
x AS (SELECT event_id, field, json_extract_string(before_state, '$.' || field) AS before, json_extract_string(after_state, '$.' || field) AS after FROM f)
SELECT * FROM x WHERE before IS DISTINCT FROM after""")
def a5(spark, d):
    return au.audit_diff(fx(spark, d, "fx_audit"))


@query("a6_audit_expire", f"SELECT event_id FROM fx_audit WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def a6(spark, d):
    return au.audit_expire(fx(spark, d, "fx_audit"), now(), 10).select("event_id")


@query("a7_actor_trail", """
SELECT event_id, timestamp, event_type, result FROM fx_audit WHERE actor_id = 'key_7' ORDER BY timestamp DESC, event_id DESC LIMIT 100""")
def a7(spark, d):
    return au.actor_trail(fx(spark, d, "fx_audit"), "key_7").select("event_id", "timestamp", "event_type", "result")
