"""Audit trail queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    AUDIT_QUERY_LIMIT, AUDIT_RESULTS, AUDIT_RETENTION_DAYS, AUDIT_SEVERITIES,
)
from .retention import days_before


def audit_filter(df: DataFrame, tenant: str | None = None, actor: str | None = None, event_type: str | None = None,
                 start: Column | None = None, end: Column | None = None) -> DataFrame:
    for name, value in (("tenant_id", tenant), ("actor_id", actor), ("event_type", event_type)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    if start is not None:
        df = df.filter(F.col("timestamp") >= start)
    if end is not None:
        df = df.filter(F.col("timestamp") <= end)
    return df


def audit_query(df: DataFrame, limit: int | None = AUDIT_QUERY_LIMIT, offset: int = 0, **filters) -> DataFrame:
    """One page of the matching events, newest first; all of them where ``limit`` is None."""
    rows = audit_filter(df, **filters).orderBy(F.col("timestamp").desc(), F.col("event_id").desc())
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def audit_get(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids, "event_id", "left_semi")


def audit_export(df: DataFrame, now: Column, days: int, limit: int | None = None, **filters) -> DataFrame:
    """All matching events of the last days, or the newest ``limit`` of them."""
    return audit_query(df, limit=limit, start=days_before(now, days), end=now, **filters)


def audit_summary(df: DataFrame, now: Column, days: int = 7, **filters) -> DataFrame:
    """(dimension, value, events): counts by type, and by severity and result with zeros; one pass
    with three grouping sets."""
    recent = audit_filter(df, start=days_before(now, days), end=now, **filters)
    counted = recent.groupingSets(
        [[F.col("event_type")], [F.col("severity")], [F.col("result")]], "event_type", "severity", "result"
    ).agg(F.count(F.lit(1)).alias("events"), F.grouping_id().alias("_g"))
    named = counted.select(
        F.when(F.col("_g") == 3, "event_type").when(F.col("_g") == 5, "severity").otherwise("result").alias("dimension"),
        F.coalesce("event_type", "severity", "result").alias("value"), "events")
    domain = df.sparkSession.createDataFrame(
        [("severity", v) for v in AUDIT_SEVERITIES] + [("result", v) for v in AUDIT_RESULTS],
        "dimension string, value string").withColumn("events", F.lit(0).cast("bigint"))
    return named.unionByName(domain).groupBy("dimension", "value").agg(F.sum("events").alias("events"))


def audit_diff(df: DataFrame, before: str = "before_state", after: str = "after_state") -> DataFrame:
    """(event_id, field, before, after) of every field that differs."""
    maps = df.select("event_id", F.coalesce(F.from_json(before, "map<string,string>"), F.create_map()
                                            .cast("map<string,string>")).alias("_b"),
                     F.coalesce(F.from_json(after, "map<string,string>"), F.create_map()
                                .cast("map<string,string>")).alias("_a"))
    fields = maps.withColumn("field", F.explode(F.array_union(F.map_keys("_b"), F.map_keys("_a"))))
    return (fields.select("event_id", "field", F.col("_b")[F.col("field")].alias("before"),
                          F.col("_a")[F.col("field")].alias("after"))
            .filter(~F.col("before").eqNullSafe(F.col("after"))))


def audit_expire(df: DataFrame, now: Column, days: int = AUDIT_RETENTION_DAYS) -> DataFrame:
    return df.filter(F.col("timestamp") >= days_before(now, days))


def actor_trail(df: DataFrame, actor: str, n: int = 100) -> DataFrame:
    return audit_query(df, limit=n, actor=actor)
