"""Access decisions over request logs: authentication, permissions, rate limits."""

from __future__ import annotations

import json
from collections import deque
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..plans.skew import SLICE_ROWS, chunked_fold


def micros(at: str | Column) -> Column:
    c = F.col(at) if isinstance(at, str) else at
    return F.unix_micros(c.cast("timestamp"))


# --------------------------------------------------------------------------- authentication
def _with_known(hashed: DataFrame, known: DataFrame) -> DataFrame:
    """Left join on _hash; rows without one match nothing and stay out of the shuffle, where they'd be one hot key."""
    matched = hashed.where(F.col("_hash").isNotNull()).join(known, "_hash", "left")
    return matched.unionByName(hashed.where(F.col("_hash").isNull()), allowMissingColumns=True)


def authenticate(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """key_id or the reason of failure; keys hold hashes only (key_id, key_hash)."""
    known = keys.select(F.col("key_hash").alias("_hash"), F.col("key_id"))
    hashed = requests.withColumn("_hash", F.when(
        F.col("raw_key").startswith(C.API_KEY_PREFIX), F.sha2("raw_key", 256)))
    reason = (F.when(F.col("raw_key").isNull() | (F.col("raw_key") == ""), "missing_key")
              .when(~F.col("raw_key").startswith(C.API_KEY_PREFIX), "invalid_format")
              .when(F.col("key_id").isNull(), "unknown_key"))
    return _with_known(hashed, known).drop("_hash").withColumn("failure", reason)


def authenticate_sa(requests: DataFrame, accounts: DataFrame, account_keys: DataFrame, now: Column) -> DataFrame:
    """account_id or the reason of failure; accounts carry ``keys`` (array of key_id, expires_at)."""
    listed = accounts.select("account_id", "is_active", F.explode_outer("keys").alias("_k")).select(
        "account_id", "is_active", F.col("_k.key_id").alias("key_id"), F.col("_k.expires_at").alias("expires_at"))
    active = accounts.select("account_id", F.col("is_active").alias("_active"))
    known = (account_keys.select(F.col("key_hash").alias("_hash"), "account_id", "key_id")
             .join(active, "account_id", "left")
             .join(listed.drop("is_active").withColumn("_listed", F.lit(True)), ["account_id", "key_id"], "left"))
    hashed = requests.withColumn("_hash", F.when(
        F.col("raw_key").startswith(C.SERVICE_KEY_PREFIX), F.sha2("raw_key", 256)))
    j = _with_known(hashed, known)
    reason = (F.when(~F.coalesce(F.col("raw_key").startswith(C.SERVICE_KEY_PREFIX), F.lit(False)), "invalid_format")
              .when(F.col("account_id").isNull(), "unknown_key")
              .when(~F.coalesce("_active", F.lit(False)), "inactive_account")
              .when(F.col("_listed").isNull(), "key_not_listed")
              .when(F.col("expires_at") < now, "expired"))
    return j.withColumn("failure", reason).drop("_hash", "_active", "_listed", "expires_at")


def sa_usage(authenticated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per account: last_active, total_requests; per key: last_used) of successful requests."""
    ok = authenticated.filter(F.col("failure").isNull())
    return (ok.groupBy("account_id").agg(F.max("ts").alias("last_active"), F.count(F.lit(1)).alias("total_requests")),
            ok.groupBy("account_id", "key_id").agg(F.max("ts").alias("last_used")))


# --------------------------------------------------------------------------- authorization
def _path_matches(path: Column, pattern: str) -> Column:
    parts = pattern.split("*")
    if len(parts) == 1:
        return path.startswith(pattern)
    return path.rlike("^" + ".*".join(f"\\Q{p}\\E" if p else "" for p in parts))


def required_permission(method: str | Column, path: str | Column) -> Column:
    m, p = (F.col(c) if isinstance(c, str) else c for c in (method, path))
    chain = None
    for want, pattern, permission in C.PERMISSION_RULES:
        test = _path_matches(p, pattern) if want is None else (m == want) & _path_matches(p, pattern)
        chain = F.when(test, permission) if chain is None else chain.when(test, permission)
    return chain


def project_of_request(path: str | Column, body: str | Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/projects/([^/]+)", 1), F.lit("")),
                      F.get_json_object(body, "$.project_id"))


def role_allows(role: str | Column, permission: str | Column) -> Column:
    r, p = (F.col(c) if isinstance(c, str) else c for c in (role, permission))
    return reduce(lambda a, b: a | b, [(r == name) & p.isin(allowed) for name, allowed in C.ROLE_PERMISSIONS.items()])


def authorize(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """Add role and ``allowed``; requests have key_id, permission and project_id, roles have
    key_id, role and projects (empty = all)."""
    j = requests.join(roles.select("key_id", "role", "projects"), "key_id", "left").withColumn(
        "role", F.coalesce("role", F.lit(C.DEFAULT_ROLE)))
    unrestricted = F.col("projects").isNull() | (F.size("projects") == 0)
    here = unrestricted | F.col("project_id").isNull() | F.array_contains("projects", F.col("project_id"))
    return j.withColumn("allowed", F.col("permission").isNull() | (
        role_allows("role", "permission") & F.coalesce(here, F.lit(False)))).drop("projects")


def denials(decisions: DataFrame) -> DataFrame:
    return decisions.filter(~F.col("allowed")).groupBy("role", "permission").agg(F.count(F.lit(1)).alias("denials"))


# --------------------------------------------------------------------------- rate limits
def rate_rule(path: str | Column) -> Column:
    """Requests per minute of a path; null when it is exempt."""
    p = F.col(path) if isinstance(path, str) else path
    chain = F.when(p.isin(C.RATE_EXEMPT_PATHS), F.lit(None).cast("int"))
    for prefix, limit in C.RATE_PREFIXES:
        chain = chain.when(p.startswith(prefix), F.lit(limit))
    return chain.otherwise(F.lit(C.RATE_DEFAULT))


def rate_key(raw_key: str | Column, path: str | Column, project: str | Column) -> Column:
    k = F.col(raw_key) if isinstance(raw_key, str) else raw_key
    return F.concat_ws(":", F.coalesce(k, F.lit("anonymous")), path, project)


def admit(accepted: deque, at: int, limit: int, window: int) -> tuple[bool, int]:
    """One request against the accepted ones (microseconds) of its key: (allowed, counted)."""
    while accepted and accepted[0] < at - window:
        accepted.popleft()
    counted = len(accepted)
    if counted < limit:
        accepted.append(at)
        return True, counted
    return False, counted


def admit_rows(entry: str | None, rows: pd.DataFrame, window: int) -> tuple[pd.DataFrame, str]:
    """Decisions for rows (at_us, max_requests) in time order.

    While a window is full nothing is accepted until its oldest request leaves it, so the fold jumps
    there by binary search: its cost is the accepted requests, not the rejected ones."""
    accepted = deque(json.loads(entry) if entry else [])
    at, limits = rows["at_us"].to_numpy(), rows["max_requests"].to_numpy()
    ok, counted = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype="int64")
    steady = len(at) > 0 and bool((limits == limits[0]).all())
    i = 0
    while i < len(at):
        ok[i], counted[i] = admit(accepted, int(at[i]), int(limits[i]), window)
        nxt = i + 1
        if steady and not ok[i] and accepted:
            nxt = max(nxt, int(np.searchsorted(at, accepted[0] + window, side="right")))
            counted[i:nxt] = counted[i]
        i = nxt
    return rows.assign(allowed=ok, counted=counted), json.dumps(list(accepted))


def rate_limit(requests: DataFrame, key: str, request_id: str, at: str, limit: int | str,
               window_seconds: int = C.RATE_WINDOW_SECONDS, max_rows: int = SLICE_ROWS) -> DataFrame:
    """Exact sliding-window decision for every request; only accepted requests count.

    Long keys are folded in chunks (see chunked_fold), so one busy key does not become one task."""
    max_requests = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    rows = requests.select(F.col(key).alias("rate_key"), F.col(request_id).alias("request_id"),
                           micros(at).alias("at_us"), max_requests.cast("int").alias("max_requests"))
    kind = rows.schema
    ddl = (f"rate_key {kind['rate_key'].dataType.simpleString()}, request_id {kind['request_id'].dataType.simpleString()}, "
           "at_us bigint, max_requests int, allowed boolean, counted bigint")
    window = window_seconds * 1_000_000
    folded = chunked_fold(rows, ["rate_key"], "at_us", ["at_us", "request_id"],
                          lambda entry, pdf: admit_rows(entry, pdf, window), ddl, max_rows)
    return with_rate_info(folded, window_seconds)


def with_rate_info(folded: DataFrame, window_seconds: int) -> DataFrame:
    used = F.col("counted") + F.when(F.col("allowed"), 1).otherwise(0)
    return folded.select(
        "rate_key", "request_id", "allowed",
        F.greatest(F.col("max_requests") - used, F.lit(0)).cast("bigint").alias("remaining"),
        F.floor(F.col("at_us") / 1_000_000 + window_seconds).cast("bigint").alias("reset"),
        F.when(~F.col("allowed"), F.lit(window_seconds).cast("bigint")).alias("retry_after"))


def rate_status(requests: DataFrame, now: Column, window_seconds: int = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """Used and remaining requests of every key for each endpoint class at ``now``, with zeros."""
    since = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_seconds))
    endpoints = [p for p, _ in C.RATE_PREFIXES]
    used = (requests.filter((F.col("ts") >= since) & (F.col("ts") <= now) & F.col("path").isin(endpoints))
            .groupBy("raw_key", F.col("path").alias("endpoint")).agg(F.count(F.lit(1)).alias("used")))
    grid = (requests.select("raw_key").filter(F.col("raw_key").isNotNull()).distinct()
            .withColumn("endpoint", F.explode(F.array(*[F.lit(e) for e in endpoints]))))
    left = F.greatest(rate_rule("endpoint") - F.col("used"), F.lit(0)).cast("bigint")
    return (grid.join(used, ["raw_key", "endpoint"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
            .withColumn("remaining", left).withColumn("allowed", F.col("remaining") > 0))


def rate_pressure(requests: DataFrame, key: str, request_id: str, at: str,
                  window_seconds: int = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """All requests of the key in the trailing window of each request.

    Time is cut into window-long slices; a row is counted in its slice and serves as history for
    the next one, so a busy key spreads over as many tasks as it has slices. The window's rows are those up to the request
    less those before the window: two growing frames, whose work doesn't depend on how many rows a window holds."""
    width = window_seconds * 1_000_000
    rows = requests.select(F.col(key).alias("rate_key"), F.col(request_id).alias("request_id"), micros(at).alias("_at"))
    own = rows.withColumn("_own", F.floor(F.col("_at") / width).cast("bigint"))
    spread = own.withColumn("_slice", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    along = Window.partitionBy("rate_key", "_slice").orderBy("_at")
    upto = lambda end: F.count(F.lit(1)).over(along.rangeBetween(Window.unboundedPreceding, end))
    return (spread.withColumn("in_window", upto(0) - upto(-width - 1)).filter(F.col("_slice") == F.col("_own"))
            .select("rate_key", "request_id", "in_window"))
