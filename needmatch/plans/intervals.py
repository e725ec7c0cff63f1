"""Stabbing queries: which interval of each key holds a point, as an equi join.

A version is valid from its own point to the next one's of the same key, [a, b). The line is cut dyadically: at level l
into pieces of 2**l points. An interval is the union of at most two pieces a level (of a segment tree), and a point lies
in one piece a level; so both sides name their pieces and meet in an equi join, where each pair meets exactly once. The
index is narrow (no payload), can be kept as a table, and serves any number of targets; its size doesn't depend on how
long a version stays valid.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize


def sliced_next(df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence[str], value: str, out: str) -> DataFrame:
    """``value`` of the next row of the same key in ``order`` (null for the last), one slice per task."""
    keys, order = list(keys), list(order)
    rows = df.withColumn("_slice", slice_col)
    first = rows.groupBy(*keys, "_slice").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    carried = first.select(*keys, "_slice", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (rows.join(carried, [*keys, "_slice"]).withColumn(out, F.coalesce(F.lead(value).over(inside), F.col("_carry")))
            .drop("_slice", "_carry"))


@dataclass
class IntervalIndex:
    """``pieces`` (scope, _level, _piece, key, id) of all intervals; points count from ``low`` in 2 ** ``levels`` steps."""
    pieces: DataFrame
    scope: list[str]
    low: int
    levels: int

    def stab(self, targets: DataFrame, target_id: str, at: str) -> DataFrame:
        """(scope, target_id, key, id) of the intervals of the target's scope that hold its point (a bigint).

        Targets become a row a level, which the size of their scan doesn't show: neither side is fit for a broadcast."""
        point = F.least(F.col(at).cast("long") - self.low, F.lit((1 << self.levels) - 1).cast("long"))
        levels = F.explode(F.sequence(F.lit(0), F.lit(self.levels))).alias("_level")
        asked = (targets.where(F.col(at) >= self.low).select(*[F.col(c).alias(c) for c in self.scope], target_id, point.alias("_point"), levels)
                 .withColumn("_piece", F.expr("shiftright(_point, _level)")).drop("_point"))
        return asked.join(self.pieces.hint("merge"), [*self.scope, "_level", "_piece"]).drop("_level", "_piece")


def interval_index(rows: DataFrame, scope: list[str], keys: list[str], at: str, order: list[str], keep: list[str],
                   slice_of: Callable[[Column], Column]) -> IntervalIndex:
    """Index of the intervals of each (scope, keys) of rows; ``at`` is a bigint, ``order`` breaks ties (the last row of a
    point counts), ``keep`` are columns to give back."""
    ends = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    levels = max(1, (high - low + 1).bit_length())
    named = sliced_next(rows.select(*dict.fromkeys([*scope, *keys, at, *order, *keep])), [*scope, *keys], slice_of(F.col(at)), [at, *order], at, "_next")
    begin = (F.col(at) - low).alias("_a")
    end = F.coalesce(F.col("_next") - low, F.lit(1 << levels).cast("long")).alias("_b")
    held = named.select(*dict.fromkeys([*scope, *keys, *keep]), begin, end).where("_a < _b")
    # at level l the interval has the whole pieces ceil(a / 2**l) .. floor(b / 2**l) - 1; only odd ends belong to this level
    pieces = F.expr(f"""explode(flatten(transform(sequence(0, {levels}), l -> filter(array(
        named_struct('_level', l, '_piece', shiftright(_a + shiftleft(1L, l) - 1, l),
                     'own', shiftright(_a + shiftleft(1L, l) - 1, l) < shiftright(_b, l) AND shiftright(_a + shiftleft(1L, l) - 1, l) % 2 = 1),
        named_struct('_level', l, '_piece', shiftright(_b, l) - 1,
                     'own', shiftright(_a + shiftleft(1L, l) - 1, l) < shiftright(_b, l) AND shiftright(_b, l) % 2 = 1)), p -> p.own))))""")
    index = held.withColumn("_p", pieces).select(*dict.fromkeys([*scope, *keys, *keep]), "_p._level", "_p._piece")
    return IntervalIndex(materialize(index, "interval-index"), scope, low, levels)
