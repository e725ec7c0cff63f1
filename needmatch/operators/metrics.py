"""Counters, histograms, rates, alerts, health and log queries over samples and request logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..plans.skew import exact_percentiles, order_statistics, sliced_lag, time_slice

INF = float("inf")


# --------------------------------------------------------------------------- counters and histograms
def counters(df: DataFrame, metric: str, labels: dict[str, Column]) -> DataFrame:
    """(metric, labels as JSON, value) increments per label set."""
    named = [c.cast("string").alias(name) for name, c in labels.items()]
    counted = df.groupBy(*named).agg(F.count(F.lit(1)).alias("value"))
    return counted.select(F.lit(metric).alias("metric"), F.to_json(F.struct(*labels)).alias("labels"), "value")


def histogram(df: DataFrame, value: str, labels: Sequence[str], bounds: Sequence[float] = C.HISTOGRAM_BOUNDS) -> DataFrame:
    """(labels, le, bucket, sum, count): cumulative buckets with a last infinite one."""
    v = F.col(value)
    wide = df.groupBy(*labels).agg(
        *[F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(v).alias("count"), F.sum(v).alias("sum"))
    buckets = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("bucket")) for i, b in enumerate(bounds)],
                      F.struct(F.lit(INF).alias("le"), F.col("count").alias("bucket")))
    return wide.select(*labels, F.inline(buckets), "sum", "count")


def histogram_quantile(h: DataFrame, labels: Sequence[str], q: float) -> DataFrame:
    """Linear interpolation inside the bucket that reaches rank q*count; in the infinite bucket
    the last finite bound; null without samples."""
    order = Window.partitionBy(*labels).orderBy("le")                       # a dozen buckets per label set
    rows = (h.withColumn("_lo", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
            .withColumn("_below", F.coalesce(F.lag("bucket").over(order), F.lit(0)))
            .withColumn("_rank", F.lit(float(q)) * F.col("count")))
    hit = rows.filter((F.col("bucket") >= F.col("_rank")) & (F.col("count") > 0))
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * F.try_divide(
        F.col("_rank") - F.col("_below"), (F.col("bucket") - F.col("_below")).cast("double"))
    value = F.when(F.col("le") == INF, F.col("_lo")).otherwise(F.coalesce(inside, F.col("le")))
    found = hit.groupBy(*labels).agg(F.min_by(value, "le").alias("quantile"))
    return h.select(*labels).distinct().join(found, list(labels), "left")


def avg_from_hist(h: DataFrame, labels: Sequence[str]) -> DataFrame:
    return h.select(*labels, "sum", "count").distinct().select(
        *labels, F.try_divide(F.col("sum"), F.col("count").cast("double")).alias("mean"))


# --------------------------------------------------------------------------- rates
def increase(samples: DataFrame, keys: Sequence[str], value: str, at: str, tie: str, window: str,
             seconds: int, slide: str | None = None) -> DataFrame:
    """(keys, window_start, increase, rate) of counters; a drop counts as a restart from 0.
    The first sample of a series adds nothing; no extrapolation at window edges."""
    keys = list(keys)
    linked = sliced_lag(samples, keys, time_slice(at), [at, tie], F.col(value), "_prev")
    v, p = F.col(value), F.col("_prev")
    delta = F.when(p.isNull(), F.lit(0)).when(v < p, v).otherwise(v - p)
    win = F.window(F.col(at), window, slide) if slide else F.window(F.col(at), window)
    return (linked.groupBy(*keys, win.alias("_w")).agg(F.sum(delta).alias("increase"))
            .select(*keys, F.col("_w.start").alias("window_start"), "increase",
                    (F.col("increase") / F.lit(float(seconds))).alias("rate")))


def sum_by(df: DataFrame, labels: Sequence[str], value: str = "increase") -> DataFrame:
    return df.groupBy(*labels).agg(F.sum(value).alias("total"))


def gauge_last(df: DataFrame, labels: Sequence[str], value: str, at: str, tie: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.max_by(value, F.struct(at, tie)).alias("value"))


def ratio(df: DataFrame, numerator: Column, denominator: Column, by: Sequence[Column | str]) -> DataFrame:
    """Share of rows per group; null when nothing is in the denominator."""
    counted = df.groupBy(*by).agg(F.count_if(numerator & denominator).alias("_n"), F.count_if(denominator).alias("_d"))
    return counted.withColumn("ratio", F.try_divide(F.col("_n").cast("double"), F.col("_d").cast("double"))).drop("_n", "_d")


def topk(df: DataFrame, label: str, value: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.col(value).desc(), label).limit(k)


def count_series(df: DataFrame, label: str, approximate: bool = False) -> DataFrame:
    n = F.approx_count_distinct(label) if approximate else F.count_distinct(label)
    return df.agg(n.alias("series"))


def label_filter(df: DataFrame, **matchers: tuple[str, str]) -> DataFrame:
    """label=(op, value) with op one of =, !=, =~, !~; patterns match the whole value."""
    for name, (op, value) in matchers.items():
        c = F.col(name).cast("string")
        whole = c.rlike(f"^(?:{value})$") if "~" in op else c == value
        df = df.filter(~whole if op.startswith("!") else whole)
    return df


# --------------------------------------------------------------------------- alerts
def pane(at: str, grid_seconds: int = C.ALERT_GRID_SECONDS) -> Column:
    """The evaluation time (epoch seconds) that ends the pane of a row: (t - grid, t]."""
    return F.ceil(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(grid_seconds * 1_000_000.0)).cast("bigint") * grid_seconds


def on_grid(panes: DataFrame, grid_seconds: int = C.ALERT_GRID_SECONDS, range_seconds: int = C.RATE_RANGE_SECONDS) -> DataFrame:
    """Add ``grid``: every evaluation time whose trailing range (t - range, t] holds the pane. Panes are copied
    range/grid times, never rows of data."""
    steps = F.sequence(F.lit(0), F.lit(range_seconds - grid_seconds), F.lit(grid_seconds))
    return panes.withColumn("grid", F.explode(F.transform(steps, lambda s: F.col("pane") + s)))


def bucket_quantile(q: float, buckets: Sequence[Column], count: Column, bounds: Sequence[float]) -> Column:
    """``histogram_quantile`` of cumulative buckets that stand in columns of one row."""
    rank, found = F.lit(float(q)) * count, F.when(count == 0, None)
    lows, belows = [0.0, *bounds], [F.lit(0), *buckets]
    for low, high, below, bucket in zip(lows, bounds, belows, buckets):
        found = found.when(bucket >= rank, F.lit(low) + F.lit(high - low) * ((rank - below) / (bucket - below).cast("double")))
    return found.otherwise(F.lit(float(bounds[-1])))


def request_series(df: DataFrame, at: str, shares: dict[str, Column], rates: dict[str, Column],
                   quantiles: dict[str, tuple[Column, Column, Sequence[float]]], q: float = 0.95, grid_seconds: int = C.ALERT_GRID_SECONDS,
                   range_seconds: int = C.RATE_RANGE_SECONDS) -> DataFrame:
    """(series, grid, value) over trailing ranges, all from one scan: rows are counted once into panes, and panes add up.

    ``shares``: part of the rows where a condition holds; ``rates``: sum of a column per second; ``quantiles``: of a
    value over the rows where a condition holds, from its histogram with these bounds.
    """
    sums = {"n": F.count(F.lit(1))}
    sums |= {f"s_{k}": F.count_if(c) for k, c in shares.items()} | {f"r_{k}": F.sum(c) for k, c in rates.items()}
    for k, (value, where, bounds) in quantiles.items():
        sums |= {f"q_{k}_{i}": F.count_if(where & (value <= b)) for i, b in enumerate(bounds)}
        sums[f"q_{k}_all"] = F.count_if(where & value.isNotNull())
    panes = df.groupBy(pane(at, grid_seconds).alias("pane")).agg(*[c.alias(k) for k, c in sums.items()])
    wide = on_grid(panes, grid_seconds, range_seconds).groupBy("grid").agg(*[F.sum(k).alias(k) for k in sums])
    values = {k: F.col(f"s_{k}") / F.col("n") for k in shares}
    values |= {k: F.coalesce(F.col(f"r_{k}"), F.lit(0)) / F.lit(float(range_seconds)) for k in rates}
    for k, (_, _, bounds) in quantiles.items():
        values[k] = bucket_quantile(q, [F.col(f"q_{k}_{i}") for i in range(len(bounds))], F.col(f"q_{k}_all"), bounds)
    rows = F.array(*[F.struct(F.lit(k).alias("series"), v.cast("double").alias("value")) for k, v in values.items()])
    return wide.select("grid", F.inline(rows)).where("value IS NOT NULL").select("series", "grid", "value")


def gauge_series(samples: DataFrame, at: str, tie: str, combine: dict[str, str], grid_seconds: int = C.ALERT_GRID_SECONDS,
                 range_seconds: int = C.RATE_RANGE_SECONDS) -> DataFrame:
    """(series, grid, value) of gauge samples (series, label, value): at each evaluation time the last value of every label
    not older than the range, combined over the labels by ``combine[series]`` (sum, max or min)."""
    panes = samples.groupBy("series", "label", pane(at, grid_seconds).alias("pane")).agg(
        F.max_by("value", F.struct(at, tie)).alias("last"))
    last = on_grid(panes, grid_seconds, range_seconds).groupBy("series", "label", "grid").agg(F.max_by("last", "pane").alias("value"))
    how = {"sum": F.sum, "max": F.max, "min": F.min}
    name, value = F.col("series"), F.lit(None).cast("double")
    for k, c in combine.items():
        value = F.when(F.first(name) == k, how[c](F.col("value").cast("double"))).otherwise(value)
    return last.where(name.isin(*combine)).groupBy("series", "grid").agg(value.alias("value"))


def alerts(series: DataFrame, rules: dict[str, tuple] = C.ALERT_RULES, grid_seconds: int = C.ALERT_GRID_SECONDS) -> DataFrame:
    """(alert, severity, started, fires_at, ended, peak): unbroken breaches on the grid that last at least
    the hold time. series has (series, grid, value); times are epoch seconds."""
    rule = F.explode(F.array(*[F.struct(
        F.lit(name).alias("alert"), F.lit(s).alias("of"), F.lit(op).alias("op"), F.lit(float(t)).alias("threshold"),
        F.lit(hold).alias("hold"), F.lit(sev).alias("severity")) for name, (s, op, t, hold, sev) in rules.items()]))
    v, t = F.col("value"), F.col("_r.threshold")
    breach = F.when(F.col("_r.op") == ">", v > t).otherwise(v == t)
    hit = series.withColumn("_r", rule).filter((F.col("_r.of") == F.col("series")) & breach).withColumn("alert", F.col("_r.alert"))
    along = Window.partitionBy("alert").orderBy("grid")                     # grid points, not rows of data
    islands = hit.withColumn("_i", F.col("grid") / grid_seconds - F.row_number().over(along))
    spans = islands.groupBy("alert", "_i", F.col("_r.severity").alias("severity"), F.col("_r.hold").alias("hold")).agg(
        F.min("grid").alias("started"), F.max("grid").alias("ended"), F.max("value").alias("peak"))
    return (spans.filter(F.col("ended") - F.col("started") >= F.col("hold"))
            .select("alert", "severity", "started", (F.col("started") + F.col("hold")).alias("fires_at"), "ended", "peak"))


# --------------------------------------------------------------------------- requests
def normalize_endpoint(path: str | Column) -> Column:
    """Path with id-like segments (uuid, long hex, digits, known prefixes) replaced by {id}."""
    p = F.col(path) if isinstance(path, str) else path

    def is_id(s: Column) -> Column:
        uuid = (F.length(s) == 36) & (F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit(""))) == 4)
        prefixed = reduce(lambda a, b: a | b, [s.startswith(x) for x in C.ID_SEGMENT_PREFIXES])
        return uuid | s.rlike(r"^[0-9a-fA-F_-]{16,}$") | s.rlike(r"^\d+$") | prefixed
    parts = F.split(F.trim(p, F.lit("/")), "/")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(is_id(s), "{id}").otherwise(s)), "/"))


def http_stats(requests: DataFrame) -> DataFrame:
    """Requests, errors, mean and exact quantiles of duration by method and normalized endpoint."""
    rows = requests.select("method", normalize_endpoint("path").alias("endpoint"), "status_code", "duration_ms")
    keys = ["method", "endpoint"]
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"),
                                  F.round(F.avg("duration_ms"), 6).alias("mean_ms"))
    quant = exact_percentiles(rows.select(*keys, "duration_ms"), keys, "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    return agg.join(quant.select(*keys, *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")]), keys)


def latency_summary(df: DataFrame, name: str, value: str) -> DataFrame:
    """n, mean, median, p95 (the value at index int(.95 n)), min and max per name."""
    n = F.col("n")
    stats = order_statistics(df.select(name, value), [name], value, {
        "_a": F.floor((n + 1) / 2), "_b": F.floor(n / 2) + 1, "p95": F.floor(F.lit(0.95) * n) + 1})
    agg = df.groupBy(name).agg(F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return agg.join(stats.select(name, "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"), "p95"), name)


# --------------------------------------------------------------------------- health, logs, objectives
def health(readings: DataFrame, by: str) -> DataFrame:
    """Worst status and readiness per group; a reading without value is an unhealthy component."""
    limit = reduce(lambda acc, kv: acc.when(F.col("component") == kv[0], kv[1][1]), C.HEALTH_LIMITS.items(),
                   F.when(F.lit(False), F.lit(0.0)))
    level = F.when(F.col("value").isNull(), 2).when(F.col("value") > limit, 1).otherwise(0)
    vital = F.col("component").isin(C.READINESS_COMPONENTS)
    worst = readings.withColumn("_s", level).groupBy(by).agg(
        F.max("_s").alias("_w"), F.max(F.when(vital, F.col("_s"))).alias("_v"))
    return worst.select(by, F.element_at(F.array(*[F.lit(s) for s in ("healthy", "degraded", "unhealthy")]), F.col("_w") + 1).alias("status"),
                        (F.coalesce("_v", F.lit(0)) < 2).alias("ready"))


LOG_SCHEMA = "request_id STRING, level STRING, duration_ms DOUBLE, error_type STRING, project_id STRING, message STRING"


def parse_logs(lines: DataFrame, line: str) -> DataFrame:
    return lines.select(F.from_json(line, LOG_SCHEMA).alias("_l")).select("_l.*")


def log_errors(logs: DataFrame, request_ids: DataFrame) -> DataFrame:
    return logs.filter(F.col("level") == "ERROR").join(request_ids, "request_id", "left_semi")


def slow_requests(logs: DataFrame, above_ms: float = 1000.0) -> DataFrame:
    return logs.filter(F.col("duration_ms") > above_ms)


def errors_by_type(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("level") == "ERROR").groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))


def project_logs(logs: DataFrame, project: str) -> DataFrame:
    return logs.filter(F.col("project_id") == project)


def redact(reports: DataFrame) -> DataFrame:
    """Mask sensitive headers (map column ``headers``) and query strings naming api_key; drop transient
    errors and health-check transactions."""
    noisy = reduce(lambda a, b: a | b, [F.col("transaction").contains(p) for p in C.HEALTH_PATHS])
    kept = reports.filter(~F.coalesce(F.col("error_type").isin(C.TRANSIENT_ERRORS), F.lit(False)) & ~F.coalesce(noisy, F.lit(False)))
    return (kept.withColumn("headers", F.transform_values("headers", lambda k, v: F.when(
                F.lower(k).isin(C.SENSITIVE_HEADERS), "[Filtered]").otherwise(v)))
            .withColumn("query_string", F.when(F.lower("query_string").contains("api_key"), "[Filtered]")
                        .otherwise(F.col("query_string"))))


def slo_status(metrics: DataFrame) -> DataFrame:
    """ok, warning or critical for (metric, value) rows of known metrics."""
    m, v = F.col("metric"), F.col("value")
    worse = lambda op, t: (v > t) if op == ">" else (v < t)
    chain = None
    for name, (op, warn, crit) in C.SLO_THRESHOLDS.items():
        for limit, status in ((crit, "critical"), (warn, "warning")):
            test = (m == name) & worse(op, limit)
            chain = F.when(test, status) if chain is None else chain.when(test, status)
    return metrics.withColumn("status", F.when(m.isin(list(C.SLO_THRESHOLDS)), chain.otherwise("ok")))
