"""Exact top-k of weighted term lists that stops reading a list early.

Each list (group, field, term) is cut into bands of falling impact; the band table, with the rows and the largest impact of
every band, is all that decides what to read. Three steps with one bound (a threshold algorithm):

1. the first bands of each list, until k entries are read; the k-th best partial sum is a lower bound of the k-th score;
2. bands are left out as long as the largest contributions of what is left out add up to a part (SPARE) of that bound:
   first whole lists, those with the least contribution for their length, then the low bands of the others. A node that
   stands in no band read cannot reach the bound; the k-th partial sum is a better bound, and a node whose partial sum
   and the unread contributions of all lists stay below it is out;
3. the remaining candidates add what their own entries hold in the bands left out.

All of it are equi joins and grouped sums. An entry meets the queries that need its band, never a whole block of queries;
bands above SLICE_ROWS entries are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .skew import top_per_key

BANDS = 64
SLICE_ROWS = 1 << 17
SPARE = 0.5
#: Sums may be off by this much of their size, and rounded scores by half a unit.
RELATIVE = 1e-9


def impact_bands(entries: DataFrame, group: list[str], highest: float) -> tuple[DataFrame, DataFrame]:
    """(entries with _band and _slice, band table) of entries (group, field, term, node, f), 0 < f <= highest."""
    placed = materialize(with_band(entries, highest), "impact-entries")
    return sliced_bands(placed, group)


def with_band(entries: DataFrame, highest: float) -> DataFrame:
    band = F.least(F.floor((1 - F.col("f") / F.lit(highest)) * BANDS), F.lit(BANDS - 1)).cast("int")
    return entries.withColumn("_band", F.greatest(band, F.lit(0)))


def sliced_bands(placed: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    key = [*group, "field", "term", "_band"]
    bands = materialize(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), F.max("f").alias("_most"))
                        .withColumn("_slices", F.ceil(F.col("_rows") / F.lit(SLICE_ROWS)).cast("int")), "bands")
    hot = bands.where(F.col("_slices") > 1).select(*[F.col(c).alias(c) for c in key], "_slices")
    if hot.isEmpty():
        return placed.withColumn("_slice", F.lit(0)), bands
    sliced = (placed.join(hot, key, "left")
              .withColumn("_slice", F.pmod(F.xxhash64("node"), F.coalesce("_slices", F.lit(1))).cast("int")).drop("_slices"))
    return materialize(sliced, "sliced-entries"), bands


class ListSearch:
    """Top ``k`` nodes by the best field's sum of w * f; weights: group, query, field, term, w (positive)."""

    def __init__(self, weights: DataFrame, entries: DataFrame, bands: DataFrame, group: list[str], k: int, digits: int):
        self.entries, self.group, self.k, self.digits = entries, group, k, digits
        self.of = [*group, "query", "field"]
        self.weights = weights
        along = Window.partitionBy(*group, "field", "term").orderBy("_band")
        table = bands.withColumn("_before", F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        lists = weights.join(table, [*group, "field", "term"])
        self.lists = materialize(lists, "query-bands")

    def partial(self, chosen: DataFrame) -> DataFrame:
        """Sums of the chosen bands by query, field and node."""
        key = [*self.group, "field", "term", "_band"]
        asked = chosen.select(*key, "query", "w", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))
        return (self.entries.join(asked, [*key, "_slice"]).groupBy(*self.of, "node")
                .agg(F.sum(F.col("w") * F.col("f")).alias("_sum")))

    def reached(self, sums: DataFrame) -> DataFrame:
        """The k-th best sum of each query and field; none where there are fewer nodes."""
        best = top_per_key(sums, self.of, [F.col("_sum").desc()], self.k, "_rn")
        return best.where(F.col("_rn") == self.k).select(*self.of, (F.col("_sum") * (1 - RELATIVE)).alias("_bound"))

    def bands_to_read(self) -> DataFrame:
        """``lists`` with _read: whether step two reads the band."""
        first = self.reached(self.partial(self.lists.where(F.col("_before") < self.k)))
        whole = (self.lists.groupBy(*self.of, "term").agg(F.max(F.col("w") * F.col("_most")).alias("_best"), F.sum("_rows").alias("_all"))
                 .join(first, self.of, "left").withColumn("_spare", F.coalesce("_bound", F.lit(0.0)) * SPARE))
        cheap = Window.partitionBy(*self.of).orderBy(F.col("_best") / F.col("_all"), "term").rowsBetween(Window.unboundedPreceding, 0)
        whole = whole.withColumn("_used", F.sum("_best").over(cheap)).withColumn("_left_out", F.col("_used") <= F.col("_spare"))
        every = Window.partitionBy(*self.of)
        rest = F.col("_spare") - F.coalesce(F.max(F.when(F.col("_left_out"), F.col("_used"))).over(every), F.lit(0.0))
        lists = whole.select(*self.of, "term", "_left_out", (rest / F.count_if(~F.col("_left_out")).over(every)).alias("_share"))
        enough = ~F.col("_left_out") & (F.col("w") * F.col("_most") >= F.col("_share"))
        read = (F.col("_before") < self.k) | enough
        return materialize(self.lists.join(lists, [*self.of, "term"]).withColumn("_read", read).drop("_left_out", "_share"), "bands-to-read")

    def candidates(self, chosen: DataFrame) -> DataFrame:
        """(group, query, field, node, _sum): nodes that can still be among the best, with their sums of the bands read."""
        sums = materialize(self.partial(chosen.where("_read")), "partial-sums")
        unread = (chosen.where(~F.col("_read")).groupBy(*self.of, "term").agg(F.max(F.col("w") * F.col("_most")).alias("_left"))
                  .groupBy(*self.of).agg(F.sum("_left").alias("_left")))
        bounds = (sums.select(*self.of).distinct().join(self.reached(sums), self.of, "left").join(unread, self.of, "left")
                  .select(*self.of, F.coalesce("_bound", F.lit(0.0)).alias("_bound"), F.coalesce("_left", F.lit(0.0)).alias("_left")))
        slack = F.lit(10.0 ** -self.digits)
        return materialize(
            sums.join(bounds, self.of).where(F.col("_sum") * (1 + RELATIVE) + F.col("_left") >= F.col("_bound") - slack)
            .drop("_bound", "_left"), "candidates")

    def top(self) -> DataFrame:
        """(group, query, node, score, rank)."""
        chosen = self.bands_to_read()
        candidates = self.candidates(chosen)
        held = self.entries.select(*self.group, "field", "node", "term", "_band", "f")
        unread = chosen.where(~F.col("_read")).select(*self.of, "term", "_band", "w")
        rest = (candidates.drop("_sum").join(held, [*self.group, "field", "node"]).join(unread, [*self.of, "term", "_band"])
                .select(*self.of, "node", (F.col("w") * F.col("f")).alias("_sum")))
        full = candidates.unionByName(rest).groupBy(*self.of, "node").agg(F.sum("_sum").alias("_sum"))
        scored = (full.groupBy(*self.group, "query", "node").agg(F.round(F.max("_sum"), self.digits).alias("score"))
                  .where(F.col("score") > 0))
        return top_per_key(scored, [*self.group, "query"], [F.col("score").desc(), F.col("node")], self.k, "rank")
