"""Walks over JSON documents as chains of generators: one per level, no shuffle, no recursion
limits of recursive queries and no row limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def is_object(v: Column) -> Column:
    """Shallow test: nothing below the first level is looked at."""
    return v.try_cast("map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return v.try_cast("array<variant>").isNotNull()


def is_object_array(v: Column) -> Column:
    return is_object(F.try_variant_get(v, "$[0]", "variant"))


def is_empty(v: Column) -> Column:
    return F.to_json(v).isin("{}", "[]")


def as_text(v: Column) -> Column:
    """Scalar as plain text, containers as JSON."""
    return F.when(is_object(v) | is_array(v), F.to_json(v)).otherwise(v.cast("string"))


def explode_level(df: DataFrame, open_value: Column) -> DataFrame:
    """One generator step: rows with ``open_value`` set become their children (_pos, _key, _value),
    the others stay as one row with nulls."""
    stepped = df.withColumn("_open", open_value)
    return stepped.sparkSession.sql(
        "SELECT d.*, t.pos AS _pos, t.key AS _key, t.value AS _value "
        "FROM {src} d, LATERAL variant_explode_outer(d._open) t", src=stepped)
