"""Queries over the event log."""

from pyspark.sql import functions as F

from ..operators import eventlog as ev
from ..session import fresh_path
from ..sources.tables import SlicedLog, read_events
from .fixtures import fx
from .registry import query

VERSION_REQUESTS = """
SELECT project_id, CASE WHEN id % 300 = 7 THEN concat(data_key, '_x') ELSE data_key END AS data_key, sequence, created_at, id
FROM fx_log"""
DIFF_PAIRS = """
SELECT project_id, data_key, sequence AS from_sequence, sequence + CAST(id % 3 AS BIGINT) * 15 AS to_sequence
FROM fx_log"""
CURSORS = """
SELECT project_id, agent_id, CASE WHEN length(agent_id) = 7 THEN '12-0' WHEN last_sequence % 11 = 0 THEN 'abc'
       ELSE CAST(last_sequence AS VARCHAR(20)) END AS since
FROM fx_agents"""


def derived(spark, d, sql):
    """Run a portable text over the fixture log or agents."""
    name = "fx_log" if "fx_log" in sql else "fx_agents"
    return spark.sql(sql.replace(name, "{src}"), src=fx(spark, d, name))


@query("s1_scan_events", """
SELECT id, project_id, data_key, sequence, data FROM fx_log
WHERE project_id = 'proj_7' AND sequence > 1000
  AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-25 00:00:00'""")
def s1(spark, d):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return read_events(fx(spark, d, "fx_log"), project="proj_7", after_sequence=1000,
                       start=t("2024-01-05 00:00:00"), end=t("2024-01-25 00:00:00")
                       ).select("id", "project_id", "data_key", "sequence", "data")


@query("s2_append_events", """
SELECT l.id, l.project_id, m.mx + row_number() OVER (PARTITION BY l.project_id ORDER BY l.created_at, l.id) AS sequence
FROM fx_log l JOIN (SELECT project_id, max(sequence) AS mx FROM fx_log GROUP BY project_id) m ON l.project_id = m.project_id""")
def s2(spark, d):
    log = fx(spark, d, "fx_log")
    return ev.append_events(log, log).select("id", "project_id", "sequence")


PUBLISH_ITEMS = """
SELECT id, project_id, CASE WHEN id % 53 = 0 THEN '' ELSE data_key END AS data_key,
       CASE WHEN id % 4 = 0 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN id % 41 = 0 THEN 'oops' ELSE data END AS data, created_at
FROM fx_log"""


@query("s3_batch_publish", f"""
WITH i AS ({PUBLISH_ITEMS}),
m AS (SELECT project_id, max(sequence) AS mx FROM fx_log GROUP BY project_id),
j AS (SELECT id, project_id, created_at, coalesce(event_type, data_key || '_updated') AS event_type,
        CASE WHEN data_key <> '' AND json_valid(data) THEN 'success' ELSE 'failed' END AS status FROM i)
SELECT j.id, j.project_id, j.event_type, j.status, CASE WHEN status = 'success' THEN
   mx + row_number() OVER (PARTITION BY j.project_id, status ORDER BY created_at, id) END AS sequence
FROM j JOIN m ON j.project_id = m.project_id""")
def s3(spark, d):
    items = derived(spark, d, PUBLISH_ITEMS)
    return ev.batch_publish(items, fx(spark, d, "fx_log"))[0].select(
        "id", "project_id", "event_type", "status", "sequence")


@query("s3_batch_summary", f"""
WITH i AS ({PUBLISH_ITEMS})
SELECT count(*) AS total, count(*) FILTER (data_key <> '' AND json_valid(data)) AS successful,
       count(*) FILTER (NOT (data_key <> '' AND json_valid(data))) AS failed FROM i""")
def s3b(spark, d):
    return ev.batch_publish(derived(spark, d, PUBLISH_ITEMS), fx(spark, d, "fx_log"))[1]


E1_SQL = f"""
WITH c AS ({CURSORS}),
p AS (SELECT project_id, agent_id, CASE WHEN since LIKE '%-%' THEN 0 ELSE coalesce(TRY_CAST(since AS BIGINT), 0) END AS since FROM c),
r AS (SELECT p.agent_id, l.project_id, l.id, l.sequence, l.data,
        row_number() OVER (PARTITION BY p.agent_id ORDER BY l.sequence) AS n
      FROM p JOIN fx_log l ON l.project_id = p.project_id AND l.sequence > p.since)
SELECT agent_id, project_id, id, sequence, data, n FROM r WHERE n <= 10"""


@query("e1_events_since", E1_SQL)
def e1(spark, d):
    return ev.events_since(fx(spark, d, "fx_log"), derived(spark, d, CURSORS), "agent_id", "since", 10).select(
        "agent_id", "project_id", "id", "sequence", "data", "n")


@query("e1_events_since_stored", E1_SQL)
def e1s(spark, d):
    """From a stored log and its zone map, appended in two halves."""
    log = fx(spark, d, "fx_log")
    stored = SlicedLog(spark, fresh_path(spark, "stored-log"), 1000)
    for half in (0, 1):
        stored.append(log.where(F.col("id") % 2 == half))
    return ev.stored_events_since(stored, derived(spark, d, CURSORS), "agent_id", "since", 10).select(
        "agent_id", "project_id", "id", "sequence", "data", "n")


@query("e2_all_events", """
SELECT id, project_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY sequence) AS rn FROM fx_log)
WHERE rn <= 100""")
def e2(spark, d):
    return ev.all_events(fx(spark, d, "fx_log"), 100).select("id", "project_id", "sequence")


@query("e3_events_by_type", """
SELECT id, project_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY sequence) AS rn
  FROM fx_log WHERE event_type = 'click_1_updated') WHERE rn <= 50""")
def e3(spark, d):
    return ev.all_events(fx(spark, d, "fx_log"), 50, "click_1_updated").select("id", "project_id", "sequence")


@query("e4_latest_sequence", "SELECT project_id, max(sequence) AS latest_sequence FROM fx_log GROUP BY 1")
def e4(spark, d):
    return ev.latest_sequence(fx(spark, d, "fx_log"))


@query("e5_stream_length", "SELECT project_id, count(*) AS length FROM fx_log GROUP BY 1")
def e5(spark, d):
    return ev.stream_length(fx(spark, d, "fx_log"))


@query("e6_events_by_tenant", "SELECT tenant_id, count(*) AS events FROM fx_log GROUP BY 1")
def e6(spark, d):
    return ev.tenant_counts(fx(spark, d, "fx_log"))


@query("e7_events_in_range", """
SELECT id, project_id, created_at FROM fx_log
WHERE created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""")
def e7(spark, d):
    return ev.events_in_range(fx(spark, d, "fx_log"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"),
                              F.lit("2024-01-12 12:00:00").cast("timestamp_ntz")).select("id", "project_id", "created_at")


@query("e8_paginate", """
WITH p AS (SELECT project_id, sequence, CAST(floor((row_number() OVER (PARTITION BY project_id ORDER BY sequence) - 1) / 100) AS BIGINT) AS page FROM fx_log)
SELECT project_id, page, count(*) AS events, min(sequence) AS first_sequence, max(sequence) AS next_since FROM p GROUP BY 1, 2""")
def e8(spark, d):
    return ev.pages(fx(spark, d, "fx_log"))


STATE_SQL = """
SELECT t.project_id, t.target_id, l.data_key, arg_max(l.data, l.sequence) AS data, max(l.sequence) AS sequence
FROM fx_targets t JOIN fx_log l ON l.project_id = t.project_id AND l.sequence <= t.at_sequence GROUP BY 1, 2, 3"""


@query("e9_state_as_of", STATE_SQL)
def e9(spark, d):
    return ev.state_as_of(fx(spark, d, "fx_log"), fx(spark, d, "fx_targets"), "target_id", "at_sequence")


TIMES = "SELECT project_id, agent_id, last_seen AS wanted FROM fx_agents WHERE last_seen IS NOT NULL"


@query("e9_state_as_of_time", f"""
WITH t AS ({TIMES})
SELECT t.project_id, t.agent_id, l.data_key, arg_max(l.data, l.sequence) AS data, max(l.sequence) AS sequence
FROM t JOIN fx_log l ON l.project_id = t.project_id AND l.created_at <= t.wanted GROUP BY 1, 2, 3""")
def e9t(spark, d):
    t = derived(spark, d, TIMES).withColumn("wanted", F.col("wanted").cast("timestamp_ntz"))
    return ev.state_as_of(fx(spark, d, "fx_log"), t, "agent_id", "wanted", "created_at")


@query("e10_create_snapshot", f"""
WITH s AS ({STATE_SQL}),
k AS (SELECT target_id, count(*) AS data_keys FROM s GROUP BY 1),
n AS (SELECT t.target_id, any_value(t.at_sequence) AS at_sequence, count(*) AS events_replayed
      FROM fx_targets t JOIN fx_log l ON l.project_id = t.project_id AND l.sequence <= t.at_sequence GROUP BY 1)
SELECT s.project_id, s.target_id, n.at_sequence AS snapshot_sequence, n.events_replayed, k.data_keys, s.data_key, s.data, s.sequence
FROM s JOIN k ON k.target_id = s.target_id JOIN n ON n.target_id = s.target_id""")
def e10(spark, d):
    return ev.create_snapshots(fx(spark, d, "fx_log"), fx(spark, d, "fx_targets"), "target_id", "at_sequence")


@query("e11_latest_snapshot", """
SELECT project_id, sequence, created_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, sequence DESC) AS rn FROM fx_snapshot_points) WHERE rn = 1""")
def e11(spark, d):
    return ev.latest_snapshot(fx(spark, d, "fx_snapshot_points"))


@query("e12_list_snapshots", """
SELECT * FROM (SELECT project_id, sequence, created_at, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, sequence DESC) AS rank
  FROM fx_snapshot_points) WHERE rank <= 3""")
def e12(spark, d):
    return ev.list_snapshots(fx(spark, d, "fx_snapshot_points"), 3)


@query("e12_get_snapshot", """
SELECT t.project_id, t.target_id, t.sequence, s.created_at, s.sequence IS NOT NULL AS found
FROM (SELECT project_id, target_id, at_sequence AS sequence FROM fx_targets) t
LEFT JOIN fx_snapshot_points s ON s.project_id = t.project_id AND s.sequence = t.sequence""")
def e12g(spark, d):
    keys = fx(spark, d, "fx_targets").select(
        "project_id", "target_id", F.col("at_sequence").alias("sequence"))
    return ev.get_snapshot(fx(spark, d, "fx_snapshot_points"), keys)


@query("e13_closest_snapshot", """
SELECT t.project_id, t.target_id, t.at_sequence, max(s.sequence) AS snapshot_sequence
FROM fx_targets t LEFT JOIN fx_snapshot_points s ON s.project_id = t.project_id AND s.sequence <= t.at_sequence GROUP BY 1, 2, 3""")
def e13(spark, d):
    return ev.closest_snapshot(fx(spark, d, "fx_snapshot_points"), fx(spark, d, "fx_targets"), "target_id", "at_sequence")


@query("e14_state_from_snapshot", STATE_SQL)
def e14(spark, d):
    log, snaps, targets = (fx(spark, d, n) for n in ("fx_log", "fx_snapshot_points", "fx_targets"))
    points = snaps.select("project_id", F.col("sequence").alias("snapshot_sequence"),
                          F.col("sequence").alias("_at"))
    entries = ev.state_as_of(log, points, "snapshot_sequence", "_at")
    return ev.state_from_snapshot(log, entries, snaps, targets, "target_id", "at_sequence")


@query("e15_snapshot_retention", """
SELECT * FROM (SELECT project_id, sequence, created_at, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, sequence DESC) AS rank
  FROM fx_snapshot_points) WHERE rank <= 2""")
def e15(spark, d):
    return ev.keep_latest_snapshots(fx(spark, d, "fx_snapshot_points"), 2)


@query("e16_version_history", """
SELECT * FROM (SELECT project_id, data_key, sequence, data, row_number() OVER (PARTITION BY project_id, data_key ORDER BY sequence DESC) AS rank
  FROM fx_log) WHERE rank <= 5""")
def e16(spark, d):
    return ev.version_history(fx(spark, d, "fx_log"), 5).select("project_id", "data_key", "sequence", "data", "rank")


@query("e17_version_at", f"""
WITH k AS ({VERSION_REQUESTS})
SELECT k.project_id, k.data_key, k.sequence, l.data, l.id IS NOT NULL AS found
FROM k LEFT JOIN fx_log l ON l.project_id = k.project_id AND l.data_key = k.data_key AND l.sequence = k.sequence""")
def e17(spark, d):
    keys = derived(spark, d, VERSION_REQUESTS).select("project_id", "data_key", "sequence")
    return ev.version_at(fx(spark, d, "fx_log"), keys)


@query("e18_version_diff", f"""
WITH p AS ({DIFF_PAIRS})
SELECT p.project_id, p.data_key, p.from_sequence, p.to_sequence, a.data AS from_data, b.data AS to_data,
       a.data IS DISTINCT FROM b.data AS changed
FROM p LEFT JOIN fx_log a ON a.project_id = p.project_id AND a.data_key = p.data_key AND a.sequence = p.from_sequence
LEFT JOIN fx_log b ON b.project_id = p.project_id AND b.data_key = p.data_key AND b.sequence = p.to_sequence""")
def e18(spark, d):
    return ev.version_diff(fx(spark, d, "fx_log"), derived(spark, d, DIFF_PAIRS))


@query("e19_version_chain", """
SELECT project_id, data_key, sequence, sha256(data) AS data_hash, row_number() OVER w AS version,
  CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN lag(data) OVER w = data THEN 'unchanged' ELSE 'updated' END AS change_type
FROM fx_log WINDOW w AS (PARTITION BY project_id, data_key ORDER BY sequence)""")
def e19(spark, d):
    return ev.version_chain(fx(spark, d, "fx_log"))


@query("e20_restore_version", f"""
WITH k AS ({VERSION_REQUESTS}),
m AS (SELECT project_id, max(sequence) AS mx FROM fx_log GROUP BY 1),
h AS (SELECT k.id, k.project_id, k.data_key, k.sequence AS from_sequence, k.created_at, l.data FROM k
  JOIN fx_log l ON l.project_id = k.project_id AND l.data_key = k.data_key AND l.sequence = k.sequence)
SELECT h.id, h.project_id, h.data_key, h.from_sequence, h.data, 'data.restored.' || h.data_key AS event_type,
  mx + row_number() OVER (PARTITION BY h.project_id ORDER BY h.created_at, h.id) AS sequence
FROM h JOIN m ON m.project_id = h.project_id""")
def e20(spark, d):
    return ev.restore_versions(fx(spark, d, "fx_log"), derived(spark, d, VERSION_REQUESTS)).drop("created_at")


@query("e21_top_updated_keys", "SELECT data_key, count(*) AS updates FROM fx_log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def e21(spark, d):
    return ev.top_keys(fx(spark, d, "fx_log"))


@query("e22_updates_by_hour", "SELECT date_trunc('hour', created_at) AS hour, count(*) AS updates FROM fx_log GROUP BY 1")
def e22(spark, d):
    return ev.updates_by_hour(fx(spark, d, "fx_log"))


@query("e22_peak_hours", """
SELECT date_trunc('hour', created_at) AS hour, count(*) AS updates FROM fx_log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def e22p(spark, d):
    return ev.peak_hours(fx(spark, d, "fx_log"))


@query("e23_replay", """
WITH m AS (SELECT DISTINCT project_id, 'copy_' || (CAST(substr(project_id, 6) AS BIGINT) % 7) AS new_project_id FROM fx_log)
SELECT l.id, m.new_project_id AS project_id, l.sequence AS from_sequence, l.data_key,
  row_number() OVER (PARTITION BY m.new_project_id ORDER BY l.id) AS sequence
FROM fx_log l JOIN m ON m.project_id = l.project_id""")
def e23(spark, d):
    log = fx(spark, d, "fx_log")
    mapping = log.select("project_id").distinct().withColumn(
        "new_project_id", F.concat(F.lit("copy_"), F.substring("project_id", 6, 20).cast("bigint") % 7))
    return ev.replay(log, mapping).select("id", "project_id", "from_sequence", "data_key", "sequence")
