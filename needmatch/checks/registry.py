"""Registered queries and their SQL statements of the same result."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from .fixtures import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FAMILIES = [
    "events", "ingest", "nodes", "search", "context", "subscribe", "retention", "audit",
    "tenancy", "access", "webhooks", "metrics", "streams",
]


def query(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder.rstrip("/"))
        assert name not in QUERIES, name
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = with_fixtures(oracle)
        return fn
    return add


def load_all() -> None:
    for family in FAMILIES:
        if importlib.util.find_spec(f"needmatch.checks.{family}") is None:
            continue
        importlib.import_module(f"needmatch.checks.{family}")
