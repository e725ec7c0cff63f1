"""Retention of events and agents. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import EVENT_TTL_DAYS, INACTIVE_AGENT_DAYS, MAX_EVENTS_PER_PROJECT
from ..plans.skew import id_slice, sliced_newest


def days_before(now: Column, days: int) -> Column:
    return now - F.expr(f"INTERVAL '{int(days)}' DAY")


def expire_by_age(log: DataFrame, now: Column, ttl_days: int = EVENT_TTL_DAYS) -> DataFrame:
    return log.filter(F.col("created_at") >= days_before(now, ttl_days))


def expired_counts(log: DataFrame, now: Column, ttl_days: int = EVENT_TTL_DAYS) -> DataFrame:
    old = log.filter(F.col("created_at") < days_before(now, ttl_days))
    return old.groupBy("project_id").agg(F.count(F.lit(1)).alias("deleted"))


def trim_to_count(log: DataFrame, n: int = MAX_EVENTS_PER_PROJECT) -> DataFrame:
    """Newest ``n`` events of each project by sequence."""
    return sliced_newest(log, ["project_id"], id_slice("sequence"), "sequence", n)


def expire_agents(agents: DataFrame, now: Column, days: int = INACTIVE_AGENT_DAYS) -> DataFrame:
    """Drop agents not seen for ``days``; agents never seen are kept."""
    return agents.filter(F.col("last_seen").isNull() | (F.col("last_seen") >= days_before(now, days)))


def cleanup(log: DataFrame, agents: DataFrame, now: Column, ttl_days: int = EVENT_TTL_DAYS,
            max_events: int = MAX_EVENTS_PER_PROJECT, agent_days: int = INACTIVE_AGENT_DAYS
            ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(kept log, kept agents, statistics per project, agents removed): by age, then by count.

    The statistics need only counts: what the count limit removes is max(0, young - limit)."""
    young = expire_by_age(log, now, ttl_days)
    fresh = F.col("created_at") >= days_before(now, ttl_days)
    stats = log.groupBy("project_id").agg(
        F.count_if(~fresh).alias("expired"), F.count_if(fresh).alias("_young")).select(
        "project_id", "expired", F.greatest(F.col("_young") - max_events, F.lit(0)).alias("trimmed"),
        F.least(F.col("_young"), F.lit(max_events)).cast("bigint").alias("kept"))
    kept_agents = expire_agents(agents, now, agent_days)
    gone = agents.agg(F.count_if(F.col("last_seen") < days_before(now, agent_days)).alias("agents_removed"))
    return trim_to_count(young, max_events), kept_agents, stats, gone


def retention_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("project_id").agg(F.count(F.lit(1)).alias("events"), F.min("created_at").alias("oldest"),
                                         F.max("created_at").alias("newest"))
