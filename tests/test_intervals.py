"""Versions as intervals, against a scan of the log."""

import datetime as dt
import random

import pytest

from needmatch.operators import eventlog as ev

LOG = "id long, project_id string, data_key string, data string, sequence long, created_at timestamp_ntz"
BEGIN = dt.datetime(2024, 1, 1)


def log_rows(seed, n=3000, hot=False):
    """One key holds most rows, others rarely change; several events share a time."""
    r = random.Random(seed)
    out, sequence = [], 0
    for i in range(n):
        sequence += r.choice([1, 1, 2, 900])
        key = "hot" if hot or r.random() < 0.7 else f"k{r.randrange(40)}"
        out.append((i, f"p{r.randrange(3)}", key, f"v{i}", sequence, BEGIN + dt.timedelta(minutes=i // 4 * r.choice([1, 1]))))
    return out


def plain(rows, targets, at):
    out = []
    for project, target, point in targets:
        best = {}
        for _, p, key, data, sequence, time in rows:
            if p == project and point is not None and (sequence if at == "sequence" else time) <= point:
                if key not in best or best[key][0] < sequence:
                    best[key] = (sequence, data)
        out += [(project, target, k, d, s) for k, (s, d) in best.items()]
    return sorted(out)


def found(df):
    return sorted((r.project_id, r.target_id, r.data_key, r.data, r.sequence) for r in df.collect())


@pytest.mark.parametrize("hot", [False, True])
def test_state_by_sequence(spark, hot):
    rows = log_rows(1, hot=hot)
    last = rows[-1][4]
    points = [0, 1, -5, rows[0][4], rows[0][4] - 1, last, last + 1, last * 50, None] + list(range(1, last, last // 40))
    targets = [(f"p{i % 4}", i, p) for i, p in enumerate(points)]
    log = spark.createDataFrame(rows, LOG).repartition(3)
    asked = spark.createDataFrame(targets, "project_id string, target_id int, at long")
    index = ev.state_index(log)
    assert index.pieces.groupBy("project_id", "data_key", "sequence").count().count() == len(rows)
    assert found(ev.state_as_of(log, asked, "target_id", "at", index=index)) == plain(rows, targets, "sequence")


def test_state_by_time(spark):
    rows = log_rows(2)
    points = [BEGIN + dt.timedelta(minutes=m, seconds=s) for m in (-1, 0, 1, 30, 500, 749, 9000) for s in (0, 30)]
    targets = [(f"p{i % 3}", i, p) for i, p in enumerate(points)]
    asked = spark.createDataFrame(targets, "project_id string, target_id int, at timestamp_ntz")
    log = spark.createDataFrame(rows, LOG)
    assert found(ev.state_as_of(log, asked, "target_id", "at", "created_at")) == plain(rows, targets, "time")


def test_each_target_has_its_own_base(spark):
    rows = log_rows(3, 800)
    last = rows[-1][4]
    log = spark.createDataFrame(rows, LOG)
    snaps = spark.createDataFrame([("p0", last // 2), ("p0", last // 3), ("p1", last // 2)], "project_id string, sequence long")
    targets = [(f"p{i % 3}", i, i * last // 11) for i in range(13)]
    asked = spark.createDataFrame(targets, "project_id string, target_id int, at long")
    entries = ev.state_as_of(log, snaps.selectExpr("project_id", "sequence AS snapshot_sequence", "sequence AS _at"), "snapshot_sequence", "_at")
    # snapshots are trusted: their entries are not read from the log again
    entries = entries.selectExpr("project_id", "snapshot_sequence", "data_key", "concat('snap ', data) AS data", "sequence")
    got = found(ev.state_from_snapshot(log, entries, snaps, asked, "target_id", "at"))
    bases = {(p, t): max((s for q, s in [("p0", last // 2), ("p0", last // 3), ("p1", last // 2)] if q == p and s <= at), default=0)
             for p, t, at in targets}
    want = [(p, t, k, f"snap {d}" if s <= bases[p, t] else d, s) for p, t, k, d, s in plain(rows, targets, "sequence")]
    assert got == sorted(want)


def test_one_payload_scan(spark, tmp_path):
    spark.createDataFrame(log_rows(4, 200), LOG).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    asked = spark.createDataFrame([("p0", 1, 100)], "project_id string, target_id int, at long")
    plan = ev.state_as_of(log, asked, "target_id", "at")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "data#" in line.split("ReadSchema")[0].split("[")[1]]
    assert len(scans) == 1 and plan.count("FileScan") == 2 and "Window" not in plan


def test_empty(spark):
    log = spark.createDataFrame([], LOG)
    asked = spark.createDataFrame([("p0", 1, 100)], "project_id string, target_id int, at long")
    assert ev.state_as_of(log, asked, "target_id", "at").count() == 0


def test_no_side_of_time_travel_is_broadcast(spark):
    """Exploded targets and encoded logs look small to the planner; the driver must not collect them."""
    rows = log_rows(5, 200)
    log = spark.createDataFrame(rows, LOG)
    targets = spark.createDataFrame([(f"p{i % 3}", i, i * 7) for i in range(30)], "project_id string, target_id long, at long")
    points = targets.select("project_id", targets["at"].alias("snapshot_sequence"), targets["at"].alias("_at")).distinct()
    entries = ev.state_as_of(log, points, "snapshot_sequence", "_at")
    snaps = points.select("project_id", points["_at"].alias("sequence"))
    for df in (ev.state_as_of(log, targets, "target_id", "at"), ev.state_from_snapshot(log, entries, snaps, targets, "target_id", "at")):
        joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
        assert not [line for line in joins if "_carry" not in line and "_slice" not in line], joins
