"""Append-only event log: sequencing, catch-up, time travel, snapshots, versions.

A log has columns id, project_id, tenant_id, data_key, event_type, data, sequence, created_at with
``sequence`` unique and increasing per project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import EVENTS_PAGE, SNAPSHOTS_KEPT
from ..plans.intervals import IntervalIndex, interval_index
from ..plans.skew import SLICE_SECONDS, as_of, id_slice, ranged_row_number, sliced_lag, sliced_row_number, top_per_key
from ..session import materialize
from ..sources.tables import SlicedLog

#: Slices to read are a broadcast up to this many.
MAX_BROADCAST_SLICES = 100_000


def latest_sequence(log: DataFrame) -> DataFrame:
    return log.groupBy("project_id").agg(F.max("sequence").alias("latest_sequence"))


def append_events(batch: DataFrame, log: DataFrame, order: tuple[str, ...] = ("created_at", "id"),
                  renumber: bool = False) -> DataFrame:
    """Batch rows with sequence = (last of the project or 0) + position in the batch by ``order``.

    ``renumber`` starts at 1."""
    start = None
    if not renumber:
        start = log.groupBy("project_id").agg(F.max("sequence").alias("_start"))
    return ranged_row_number(batch.drop("sequence"), ["project_id"], list(order), "sequence", start=start)


def batch_publish(items: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-item results and totals; an item needs project, key and a JSON payload."""
    typed = items.withColumn("event_type", F.coalesce("event_type", F.concat("data_key", F.lit("_updated"))))
    ok = ((F.length("project_id") > 0) & (F.length("data_key") > 0)
          & F.try_parse_json("data").isNotNull())
    marked = typed.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "success").otherwise("failed"))
    good = append_events(marked.filter(F.col("status") == "success"), log)
    failed = marked.filter(F.col("status") == "failed").withColumn("sequence", F.lit(None).cast("bigint"))
    results = good.unionByName(failed.select(good.columns))
    summary = marked.agg(F.count(F.lit(1)).alias("total"),
                         F.count_if(F.col("status") == "success").alias("successful"),
                         F.count_if(F.col("status") == "failed").alias("failed"))
    return results, summary


def parse_since(col: str | Column) -> Column:
    """Cursor text to sequence: anything with '-' or not a number counts from the start."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(c.contains("-"), F.lit(0)).otherwise(F.coalesce(c.try_cast("bigint"), F.lit(0))).cast("bigint")


def positions(log: DataFrame, out: str = "position") -> DataFrame:
    """Dense 1-based position of every event in its project."""
    return sliced_row_number(log, ["project_id"], id_slice("sequence"), ["sequence"], out)


def events_since(log: DataFrame, cursors: DataFrame, cursor_id: str, since: str,
                 count: int = EVENTS_PAGE) -> DataFrame:
    """First ``count`` events after each cursor, ascending.

    Cursors become start positions by an as-of lookup and are expanded to ``count`` positions, so
    the joins are equi joins of cursors*count rows, never cursor times log. Positions are a narrow
    table of their own; the events themselves are read once, at the end."""
    placed = materialize(positions(log.select("project_id", "sequence")), "positions")
    starts = as_of(cursors.select("project_id", cursor_id, parse_since(since).alias("_since")),
                   placed, ["project_id"], "_since", "sequence", ["position"])
    wanted = starts.select(
        "project_id", cursor_id, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(count).cast("bigint"))).alias("n"),
        F.coalesce("position", F.lit(0)).alias("_from")
    ).select("project_id", cursor_id, "n", (F.col("_from") + F.col("n")).alias("position"))
    found = placed.join(wanted, ["project_id", "position"]).drop("position")
    return log.join(found, ["project_id", "sequence"])


def count_since(log: DataFrame, cursors: DataFrame, cursor_id: str, since: str, count: int = EVENTS_PAGE) -> DataFrame:
    """(project_id, cursor, n): how many events ``events_since`` gives each cursor, from positions alone."""
    placed = materialize(positions(log.select("project_id", "sequence")), "positions")
    starts = as_of(cursors.select("project_id", cursor_id, parse_since(since).alias("_since")),
                   placed, ["project_id"], "_since", "sequence", ["position"])
    after = F.col("length") - F.coalesce("position", F.lit(0))
    return starts.join(stream_length(placed), "project_id").select("project_id", cursor_id, F.least(after, F.lit(count)).cast("bigint").alias("n"))


def stored_events_since(stored: SlicedLog, cursors: DataFrame, cursor_id: str, since: str,
                        count: int = EVENTS_PAGE) -> DataFrame:
    """events_since on a stored log: the zone map names the slices that can hold the ``count`` events after each cursor,
    and only these partitions are read; positions are numbered inside them."""
    zones = materialize(stored.zones(), "zones")
    asked = cursors.select("project_id", cursor_id, parse_since(since).alias("_since")).withColumn(
        "slice", F.floor(F.col("_since") / F.lit(stored.rows)).cast("bigint"))
    at = as_of(asked, zones.withColumnRenamed("slice", "_zone_slice"), ["project_id"], "slice", "_zone_slice", ["_zone_slice", "before", "rows", "zone"])
    inside = F.coalesce(F.col("_zone_slice") == F.col("slice"), F.lit(False))
    behind = F.coalesce(F.col("before") + F.col("rows"), F.lit(0))
    at = materialize(at.select(
        "project_id", cursor_id, "_since", "slice", F.when(inside, F.col("before")).otherwise(behind).alias("_low"), behind.alias("_high"),
        F.when(inside, F.col("zone")).otherwise(F.coalesce("zone", F.lit(0)) + 1).alias("_zone")), "cursor-zones")
    # a slice has a row at least, so that count + 1 zones hold the page
    reach = at.groupBy("project_id", "_zone").agg(F.max("_high").alias("_high")).select(
        "project_id", "_high", F.explode(F.sequence(F.col("_zone"), F.col("_zone") + F.lit(count))).alias("zone"))
    needed = zones.join(reach, ["project_id", "zone"]).where(F.col("before") < F.col("_high") + count)
    needed = materialize(needed.select("project_id", "slice", "before").distinct(), "needed-slices")
    events = stored.events().join(F.broadcast(needed.where("before >= 0")) if needed.count() <= MAX_BROADCAST_SLICES else needed,
                                  ["project_id", "slice"])
    order = Window.partitionBy("project_id", "slice").orderBy("sequence")
    placed = materialize(events.select("project_id", "slice", "sequence", (F.row_number().over(order) + F.col("before")).alias("position")), "positions")
    starts = as_of(at, placed, ["project_id", "slice"], "_since", "sequence", ["position"])
    wanted = starts.select("project_id", cursor_id, F.coalesce("position", "_low").alias("_from"),
                           F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(count).cast("bigint"))).alias("n"))
    found = placed.join(wanted.select("project_id", cursor_id, "n", (F.col("_from") + F.col("n")).alias("position")), ["project_id", "position"])
    return events.drop("before").join(found.drop("position"), ["project_id", "slice", "sequence"]).drop("slice")


def all_events(log: DataFrame, count: int | None = None, event_type: str | None = None) -> DataFrame:
    """Events of each project in order, optionally one type and only the first ``count``."""
    if event_type is not None:
        log = log.filter(F.col("event_type") == event_type)
    if count is None:
        return log
    return top_per_key(log, ["project_id"], ["sequence"], count)


def stream_length(log: DataFrame) -> DataFrame:
    return log.groupBy("project_id").agg(F.count(F.lit(1)).alias("length"))


def tenant_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("events"))


def events_in_range(log: DataFrame, start, end) -> DataFrame:
    return log.filter(F.col("created_at").between(F.lit(start), F.lit(end)))


def pages(log: DataFrame, size: int = EVENTS_PAGE) -> DataFrame:
    """Page boundaries of cursor pagination."""
    return (positions(log).withColumn("page", F.floor((F.col("position") - 1) / F.lit(size)).cast("bigint"))
            .groupBy("project_id", "page")
            .agg(F.count(F.lit(1)).alias("events"), F.min("sequence").alias("first_sequence"),
                 F.max("sequence").alias("next_since")))


def _point(df: DataFrame, at: str) -> Column:
    """Sequence, or microseconds of a time."""
    return F.col(at).cast("long") if df.schema[at].dataType.typeName() in ("long", "integer", "short", "byte") else F.unix_micros(F.col(at).cast("timestamp"))


def state_index(log: DataFrame, log_at: str = "sequence") -> IntervalIndex:
    """Index of the versions of every data key by the points (sequences or times) at which they are the last one."""
    rows = log.select("project_id", "data_key", "sequence", _point(log, log_at).alias("_at"))
    cut = id_slice if log_at == "sequence" else lambda c: F.floor(c / F.lit(SLICE_SECONDS * 1_000_000)).cast("bigint")
    return interval_index(rows, ["project_id"], ["data_key"], "_at", ["sequence"], ["sequence"], cut)


def versions_at(index: IntervalIndex, targets: DataFrame, target_id: str, at: str) -> DataFrame:
    """(project_id, target_id, data_key, sequence): the version of every key that holds at each target."""
    return index.stab(targets.select("project_id", target_id, _point(targets, at).alias("_wanted")), target_id, "_wanted")


def state_as_of(log: DataFrame, targets: DataFrame, target_id: str, at: str, log_at: str = "sequence",
                index: IntervalIndex | None = None) -> DataFrame:
    """Last value of every data key of the project at each target (sequence or time).

    Targets meet an index of version intervals (``index``, or one built here) in an equi join whose rows are those of the
    answer; payloads are read once, at the end."""
    found = versions_at(index or state_index(log, log_at), targets, target_id, at)
    return _with_payload(found, log)


def _with_payload(found: DataFrame, log: DataFrame) -> DataFrame:
    """``found`` with the data of its events. A log in dictionary-encoded files looks small and isn't: it is shuffled, never
    collected by the driver for a broadcast."""
    return found.join(log.select("project_id", "sequence", "data").hint("merge"), ["project_id", "sequence"])


def create_snapshots(log: DataFrame, targets: DataFrame, target_id: str, at: str) -> DataFrame:
    """One row per snapshot entry, with the snapshot's sequence, replayed events and key count.

    A null target means the latest sequence of the project. Entries stay long rows, so a project
    with very many keys is never one cell."""
    filled = (targets.join(latest_sequence(log), "project_id", "left")
              .withColumn(at, F.coalesce(at, "latest_sequence", F.lit(0))).drop("latest_sequence"))
    entries = state_as_of(log, filled, target_id, at)
    replayed = as_of(filled.select("project_id", target_id, at),
                     materialize(positions(log.select("project_id", "sequence")), "positions"),
                     ["project_id"], at, "sequence", ["position"])
    keys = entries.groupBy("project_id", target_id).agg(F.count(F.lit(1)).alias("data_keys"))
    return (entries.join(replayed, ["project_id", target_id]).join(keys, ["project_id", target_id])
            .select("project_id", target_id, F.col(at).cast("bigint").alias("snapshot_sequence"),
                    F.coalesce("position", F.lit(0)).alias("events_replayed"), "data_keys",
                    "data_key", "data", "sequence"))


def latest_snapshot(snaps: DataFrame) -> DataFrame:
    return (snaps.groupBy("project_id")
            .agg(F.max_by("sequence", F.struct("created_at", "sequence")).alias("sequence"),
                 F.max("created_at").alias("created_at")))


def keep_latest_snapshots(snaps: DataFrame, n: int = SNAPSHOTS_KEPT) -> DataFrame:
    """Newest ``n`` snapshots of each project with their rank."""
    return top_per_key(snaps, ["project_id"], [F.col("created_at").desc(), F.col("sequence").desc()], n, "rank")


def list_snapshots(snaps: DataFrame, limit: int = SNAPSHOTS_KEPT) -> DataFrame:
    return keep_latest_snapshots(snaps, limit).orderBy("project_id", "rank")


def get_snapshot(snaps: DataFrame, keys: DataFrame) -> DataFrame:
    """Requested (project_id, sequence) pairs with a ``found`` flag."""
    have = snaps.select("project_id", "sequence", "created_at", F.lit(True).alias("found"))
    return (keys.join(have, ["project_id", "sequence"], "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


def closest_snapshot(snaps: DataFrame, targets: DataFrame, target_id: str, at: str) -> DataFrame:
    """Largest snapshot sequence not after the target (null where none)."""
    return as_of(targets.select("project_id", target_id, at),
                 snaps.select("project_id", F.col("sequence").alias("snapshot_sequence")),
                 ["project_id"], at, "snapshot_sequence", ["snapshot_sequence"])


def state_from_snapshot(log: DataFrame, entries: DataFrame, snaps: DataFrame, targets: DataFrame,
                        target_id: str, at: str, index: IntervalIndex | None = None) -> DataFrame:
    """State at each target from its closest snapshot plus only the later versions: each target has its own base, and only
    versions after it are read from the log.

    ``entries`` are stored snapshot rows (project_id, snapshot_sequence, data_key, data, sequence)."""
    based = closest_snapshot(snaps, targets, target_id, at).select("project_id", target_id, "snapshot_sequence").hint("merge")
    base = entries.select("project_id", "snapshot_sequence", "data_key", F.col("data").alias("_data"),
                          F.col("sequence").alias("_sequence")).join(
        based, ["project_id", "snapshot_sequence"])
    later = (versions_at(index or state_index(log), targets, target_id, at)
             .join(based, ["project_id", target_id])
             .filter(F.col("sequence") > F.coalesce("snapshot_sequence", F.lit(0))))
    delta = _with_payload(later, log)
    key = ["project_id", target_id, "data_key"]
    return (base.drop("snapshot_sequence").join(delta.drop("snapshot_sequence"), key, "full")
            .select(*key, F.coalesce("data", "_data").alias("data"), F.coalesce("sequence", "_sequence").alias("sequence")))


def version_history(log: DataFrame, limit: int) -> DataFrame:
    """Newest ``limit`` versions of every data key."""
    return top_per_key(log, ["project_id", "data_key"], [F.col("sequence").desc()], limit, "rank")


def version_at(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Exact (project, key, sequence) lookups; misses stay with found = false."""
    have = log.select("project_id", "data_key", "sequence", "data", F.lit(True).alias("found"))
    return (keys.join(have, ["project_id", "data_key", "sequence"], "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


def version_diff(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """Payloads at from_sequence and to_sequence of each pair and whether they differ."""
    def side(name: str) -> DataFrame:
        return log.select("project_id", "data_key", F.col("sequence").alias(f"{name}_sequence"),
                          F.col("data").alias(f"{name}_data"))
    return (pairs.join(side("from"), ["project_id", "data_key", "from_sequence"], "left")
            .join(side("to"), ["project_id", "data_key", "to_sequence"], "left")
            .withColumn("changed", ~F.col("from_data").eqNullSafe(F.col("to_data"))))


def version_chain(log: DataFrame) -> DataFrame:
    """Number the versions of every key, with change type and content hash."""
    keys = ["project_id", "data_key"]
    rows = log.select(*keys, "sequence", F.sha2("data", 256).alias("data_hash"))
    numbered = sliced_row_number(rows, keys, id_slice("sequence"), ["sequence"], "version")
    linked = sliced_lag(numbered, keys, id_slice("sequence"), ["sequence"], F.col("data_hash"), "_previous")
    return linked.withColumn(
        "change_type",
        F.when(F.col("version") == 1, "created")
        .when(F.col("_previous").eqNullSafe(F.col("data_hash")), "unchanged")
        .otherwise("updated")).drop("_previous")


def restore_versions(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Old payloads appended as new events; requests that miss are dropped."""
    old = log.select("project_id", "data_key", F.col("sequence").alias("from_sequence"), "data")
    batch = (keys.select("project_id", "data_key", F.col("sequence").alias("from_sequence"), "created_at", "id")
             .join(old, ["project_id", "data_key", "from_sequence"])
             .withColumn("event_type", F.concat(F.lit("data.restored."), "data_key")))
    return append_events(batch, log)


def top_keys(log: DataFrame, n: int = 5) -> DataFrame:
    return (log.groupBy("data_key").agg(F.count(F.lit(1)).alias("updates"))
            .orderBy(F.col("updates").desc(), "data_key").limit(n))


def updates_by_hour(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count(F.lit(1)).alias("updates"))


def peak_hours(log: DataFrame, n: int = 5) -> DataFrame:
    return updates_by_hour(log).orderBy(F.col("updates").desc(), "hour").limit(n)


def replay(log: DataFrame, project_map: DataFrame) -> DataFrame:
    """Events of mapped projects (project_id -> new_project_id) as a new log, numbered from 1."""
    moved = (log.join(project_map, "project_id").withColumn("from_sequence", F.col("sequence"))
             .drop("project_id").withColumnRenamed("new_project_id", "project_id"))
    return sliced_row_number(moved.drop("sequence"), ["project_id"], id_slice("id"), ["id"], "sequence")
