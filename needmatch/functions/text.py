"""Text column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\r"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unix(pattern: str) -> str:
    """Same pattern with '\\n' as the only line end."""
    return pattern.replace("(?m)", "(?md)")


def strip(c: str | Column) -> Column:
    return F.trim(col(c), F.lit(BLANKS))


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(unix(p)) for p in patterns])


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """All matches of one group."""
    return F.regexp_extract_all(c, F.lit(unix(pattern)), F.lit(group))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(unix(pattern))).cast("bigint")


def clip(c: Column, n: int) -> Column:
    """At most ``n`` characters, with an ellipsis when cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def staged(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once per row: the generator keeps the optimizer from pasting
    their expressions into every later use (inside lambdas that would be once per element)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
