"""Writers, schemas and plans."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from needmatch import schemas
from needmatch.checks.fixtures import fx
from needmatch.operators import eventlog as ev, ingest as ing
from needmatch.sources import tables as tb

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_schemas_parse(spark):
    for name, ddl in schemas.TABLES.items():
        assert spark.createDataFrame([], ddl).columns, name


def test_log_round_trip(spark, tmp_path):
    log = fx(spark, FOLDER, "fx_log")
    tb.append_log(ev.append_events(log, log), str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == log.count()
    hit = back.filter("project_id = 'proj_3' AND day = DATE '2024-01-09'")
    assert "PartitionFilters: [isnotnull(project_id" in plan_of(hit)


def test_bundle_csv_and_archive(spark, tmp_path):
    log, nodes, agents = (fx(spark, FOLDER, n) for n in ("fx_log", "fx_nodes", "fx_agents"))
    bundle = ing.export_project(log, nodes, agents, ["events", "agents"])
    tb.write_bundle(bundle, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).count() == log.count() + agents.count()
    tb.write_audit_csv(ing.audit_trail(log), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == log.count()
    old, kept = ing.archive_split(log, F.lit("2024-01-15").cast("timestamp_ntz"))
    tb.write_archive(old, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() + kept.count() == log.count()


def test_predicates_reach_the_scan(spark):
    plan = plan_of(entry.queries()["s1_scan_events"](spark, FOLDER))
    assert "PushedFilters" in plan and "event_id" in plan.split("PushedFilters")[1]


def test_small_top_n_is_cut_before_the_shuffle(spark):
    for name in ("e16_version_history", "e15_snapshot_retention", "w6_delivery_log"):
        assert "WindowGroupLimit" in plan_of(entry.queries()[name](spark, FOLDER)), name


def test_no_cross_joins(spark):
    for name in ("w2_route_events", "r4_notification_feed", "e9_state_as_of", "e13_closest_snapshot", "e1_events_since",
                 "v5_vector_topk", "v8_bm25_search", "k9_rate_limit", "h4_check_quota", "m4_increase"):
        plan = plan_of(entry.queries()[name](spark, FOLDER))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
