"""Catch-up from a stored log reads only the slices that the zone map names."""

import random

import pytest

from needmatch.operators import eventlog as ev
from needmatch.sources.tables import SlicedLog

LOG = "id long, project_id string, data string, sequence long"


def rows_of(seed, n=2000):
    r = random.Random(seed)
    out, last = [], {}
    for i in range(n):
        p = r.choice(["big", "big", "big", "a", "b"])
        last[p] = last.get(p, 0) + r.choice([1, 1, 1, 5, 400 if p == "a" else 2])
        out.append((i, p, f"v{i}", last[p]))
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = rows_of(1)
    log = SlicedLog(spark, str(tmp_path_factory.mktemp("log")), 100)
    log.append(spark.createDataFrame(rows[:1200], LOG))
    log.append(spark.createDataFrame(rows[1200:], LOG))     # continues slices that the first append began
    return rows, log


@pytest.mark.parametrize("count", [1, 7, 150])
def test_pages(spark, stored, count):
    rows, log = stored
    top = max(s for *_, s in rows)
    since = ["0", "-3", "1", "99", "100", "101", "x", "5-0", None, str(top), str(top - 1), str(top * 9)] + [str(i) for i in range(0, top, top // 25)]
    cursors = [(f"c{i}{p}", p, s) for i, s in enumerate(since) for p in ("big", "a", "none")]
    frame = spark.createDataFrame(cursors, "agent string, project_id string, since string")
    got = sorted((r.agent, r.n, r.sequence, r.data) for r in ev.stored_events_since(log, frame, "agent", "since", count).collect())
    want = []
    for agent, p, s in cursors:
        after = int(s) if s and s.lstrip("-").isdigit() and "-" not in s else 0
        own = sorted((q, d) for _, project, d, q in rows if project == p and q > after)
        want += [(agent, i + 1, q, d) for i, (q, d) in enumerate(own[:count])]
    assert got == sorted(want)


def test_zone_map(stored):
    rows, log = stored
    zones = log.zones().collect()
    for z in zones:
        own = [s for _, p, _, s in rows if p == z.project_id and s // 100 == z.slice]
        assert (z["rows"], z["first"], z["last"]) == (len(own), min(own), max(own))
        assert z.before == sum(1 for _, p, _, s in rows if p == z.project_id and s // 100 < z.slice)
    assert len(zones) == len({(p, s // 100) for _, p, _, s in rows})


def test_late_cursors_read_few_partitions(spark, stored):
    rows, log = stored
    top = max(s for _, p, _, s in rows if p == "big")
    frame = spark.createDataFrame([("c", "big", str(top - 20))], "agent string, project_id string, since string")
    df = ev.stored_events_since(log, frame, "agent", "since", 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    files = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    assert df.count() == 5 and len(files) > 10      # what could be read without the zone map
