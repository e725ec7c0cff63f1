"""Ordered computations per key that never put a whole key into one task.

A key may hold a third of all rows, so a plain ``Window.partitionBy(key).orderBy(..)`` is a
single-task bottleneck. Here every key is cut into *slices* along its order; windows run inside
(key, slice) and a small carry table (one row per key and slice) links neighbouring slices.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

SLICE_ROWS = 1 << 20
SLICE_SECONDS = 3600
#: Pairs that a task makes at least, as long as there are fewer tasks than the session has.
TASK_PAIRS = 1 << 17
#: Size of a quantile sketch, and how far from a rank its bracket reaches (several times the sketch's usual error).
SKETCH_SIZE = 4096
SKETCH_ERROR = 0.004
SKETCH_STEPS = 256
FREE_ROUNDS = 3


def id_slice(col: str | Column, rows: int = SLICE_ROWS) -> Column:
    """Slice of a unique integer order column: at most ``rows`` rows per (key, slice)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(rows)).cast("bigint")


def time_slice(col: str | Column, seconds: int = SLICE_SECONDS) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(F.unix_seconds(c.cast("timestamp")) / F.lit(seconds)).cast("bigint")


def _before(keys: Sequence[str], descending: bool = False):
    order = F.col("_slice").desc() if descending else F.col("_slice").asc()
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def sliced_running_sum(df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence,
                       amount: Column, out: str, descending: bool = False) -> DataFrame:
    """Inclusive running sum of ``amount`` per key in ``order``, one slice per task."""
    keys = list(keys)
    rows = df.withColumn("_slice", slice_col)
    carried = (rows.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_total"))
               .select(*keys, "_slice",
                       F.coalesce(F.sum("_total").over(_before(keys, descending)), F.lit(0)).alias("_carry")))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(carried, [*keys, "_slice"])
            .withColumn(out, F.sum(amount).over(inside) + F.col("_carry"))
            .drop("_slice", "_carry"))


def sliced_row_number(df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence,
                      out: str = "rn", descending: bool = False, start: DataFrame | None = None) -> DataFrame:
    """Exact ``row_number()`` per key; ``descending`` must match the direction of ``order``.

    ``start`` (keys + ``_start``) is added to the numbers of its keys; it meets the small carry
    table, not the rows."""
    keys = list(keys)
    rows = df.withColumn("_slice", slice_col)
    carried = (rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_total"))
               .select(*keys, "_slice",
                       F.coalesce(F.sum("_total").over(_before(keys, descending)), F.lit(0)).alias("_carry")))
    if start is not None:
        carried = (carried.join(start, keys, "left")
                   .withColumn("_carry", F.col("_carry") + F.coalesce(F.col("_start"), F.lit(0))).drop("_start"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (rows.join(carried, [*keys, "_slice"])
            .withColumn(out, (F.row_number().over(inside) + F.col("_carry")).cast("bigint"))
            .drop("_slice", "_carry"))


def ranged_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn",
                      start: DataFrame | None = None, rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """As sliced_row_number, in slices of equal size instead of equal time: sampled bounds deal (keys, order) to sorted
    partitions, so that a key and hour with all rows still spreads. A row's number is its place in the partition, less
    the place where its key begins there, plus the key's rows in earlier partitions. Rows are shuffled once."""
    keys = list(keys)
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_slice))
    dealt = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranged")      # partition << 33 | place
    placed = placed.withColumn("_slice", F.shiftright("_at", 33))
    carried = (placed.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_total"), F.min("_at").alias("_first"))
               .select(*keys, "_slice", "_first", F.coalesce(F.sum("_total").over(_before(keys)), F.lit(0)).alias("_carry")))
    if start is not None:
        carried = (carried.join(start, keys, "left")
                   .withColumn("_carry", F.col("_carry") + F.coalesce(F.col("_start"), F.lit(0))).drop("_start"))
    return (placed.join(carried, [*keys, "_slice"])
            .withColumn(out, (F.col("_at") - F.col("_first") + 1 + F.col("_carry")).cast("bigint"))
            .drop("_slice", "_carry", "_at", "_first"))


def sliced_newest(df: DataFrame, keys: Sequence[str], slice_col: Column, order_col: str, n: int) -> DataFrame:
    """The ``n`` rows per key with the largest ``order_col``; only the one slice that straddles
    the cut is ranked, all later slices pass whole."""
    keys = list(keys)
    rows = df.withColumn("_slice", slice_col)
    cut = (rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_total"))
           .select(*keys, "_slice", "_total",
                   F.coalesce(F.sum("_total").over(_before(keys, True)), F.lit(0)).alias("_carry"))
           .filter(F.col("_carry") < n))
    joined = rows.join(cut, [*keys, "_slice"])
    whole = joined.filter(F.col("_carry") + F.col("_total") <= n)
    split = joined.filter(F.col("_carry") + F.col("_total") > n)
    w = Window.partitionBy(*keys, "_slice").orderBy(F.col(order_col).desc())
    split = split.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") + F.col("_carry") <= n).drop("_rn")
    return whole.unionByName(split).drop("_slice", "_total", "_carry")


def sliced_lag(df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence[str],
               value: Column, out: str) -> DataFrame:
    """Value of the previous row of the same key (null for the first)."""
    keys, order = list(keys), list(order)
    rows = df.withColumn("_slice", slice_col).withColumn("_value", F.struct(value.alias("v")))
    last = rows.groupBy(*keys, "_slice").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carried = last.select(*keys, "_slice",
                          F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (rows.join(carried, [*keys, "_slice"])
            .withColumn(out, F.coalesce(F.lag("_value").over(inside), F.col("_carry"))["v"])
            .drop("_slice", "_carry", "_value"))


def as_of(targets: DataFrame, rows: DataFrame, keys: Sequence[str], target_at: str, row_at: str,
          values: Sequence[str], slice_of: Callable[[Column], Column] = id_slice) -> DataFrame:
    """For each target the ``values`` of the row of the same key with the largest
    ``row_at <= target_at`` (null where none). Union + last-value window per slice: no range join,
    so the work is targets + rows and not their product."""
    keys = list(keys)
    tcols = [c for c in targets.columns if c not in keys]
    t = targets.select(*keys, F.col(target_at).alias("_at"), F.lit(1).alias("_side"),
                       F.struct(*tcols).alias("_target"))
    r = rows.select(*keys, F.col(row_at).alias("_at"), F.lit(0).alias("_side"),
                    F.struct(*[F.col(v) for v in values]).alias("_row"))
    both = t.unionByName(r, allowMissingColumns=True).withColumn("_slice", slice_of(F.col("_at")))
    ends = both.groupBy(*keys, "_slice").agg(
        F.max_by("_row", F.when(F.col("_side") == 0, F.col("_at"))).alias("_end"))
    carried = ends.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(_before(keys)).alias("_carry"))
    inside = (Window.partitionBy(*keys, "_slice").orderBy("_at", "_side")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (both.join(carried, [*keys, "_slice"])
            .withColumn("_found", F.coalesce(F.last("_row", ignorenulls=True).over(inside), F.col("_carry")))
            .filter(F.col("_side") == 1)
            .select(*keys, "_target.*", *[F.col("_found")[v].alias(v) for v in values]))


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], left_by: Sequence[str], right_by: Sequence[str],
         rows: int = SLICE_ROWS) -> DataFrame:
    """All pairs of rows with equal ``keys`` (null equals null), for results much larger than both sides: columns of left,
    then those of right without the keys.

    Pairs are counted before they are made. A key with more than its part of them is cut into a grid of cells, left rows by
    ``left_by`` and right rows by ``right_by``, each with about a task's part of all pairs. So the pairs come from all tasks however
    small the tables are, neither side is broadcast, and only cells of the two sides are shuffled, never pairs."""
    keys, others = list(keys), [c for c in right.columns if c not in keys]
    named = lambda df: df.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    count = lambda df, out: df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(out))
    sizes = materialize(count(left, "_nl").join(named(count(right, "_nr")), same).select(*keys, "_nl", "_nr"), "pair-sizes")
    total = sizes.agg(F.sum(F.col("_nl") * F.col("_nr"))).first()[0] or 0.0                          # one number
    spark = left.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tasks = int(min(most, 1 + total // TASK_PAIRS))
    part = F.ceil(F.col("_nl") * F.col("_nr") * F.lit(tasks / max(total, 1.0)))
    along = F.greatest(F.ceil(F.col("_nl") / F.lit(rows)), F.round(F.sqrt(part * F.col("_nl") / F.col("_nr"))), F.lit(1))
    cut = (sizes.withColumn("_ls", F.least(along, "_nl").cast("int"))
           .withColumn("_rs", F.least(F.ceil(part / F.col("_ls")), "_nr").cast("int"))
           .where("_ls > 1 OR _rs > 1").select(*keys, "_ls", "_rs"))
    number = lambda by, n: F.pmod(F.xxhash64(*by), F.coalesce(n, F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    cell = f"struct<{', '.join(f'`{k}`:{left.schema[k].dataType.simpleString()}' for k in keys)}, _l:int, _r:int>"      # one type on both sides
    mine = (left.join(named(cut), same, "left").withColumn("_l", number(left_by, "_ls")).withColumn("_r", each("_rs"))
            .withColumn("_cell", F.struct(*keys, "_l", "_r").cast(cell)).select(*left.columns, "_cell"))
    theirs = (named(right).join(cut, same, "left").withColumn("_r", number(right_by, "_rs")).withColumn("_l", each("_ls"))
              .withColumn("_of_cell", F.struct(*[F.col(f"_of_{k}").alias(k) for k in keys], "_l", "_r").cast(cell)).select("_of_cell", *others))
    dealt = mine.repartition(tasks, "_cell").join(theirs.repartition(tasks, "_of_cell").hint("merge"), F.col("_cell") == F.col("_of_cell"))
    return dealt.select(*left.columns, *others)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, out: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order``. The limit is a literal right above the window, so every
    task cuts to ``n`` rows per key before the shuffle; meant for small ``n``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    best = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return (best.withColumn(out, F.col("_rn").cast("bigint")) if out else best).drop("_rn")


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column],
                     rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """Exact values at given 1-based ranks per key: keys, ``n`` and one column per rank name.

    Each rank is an expression over ``n`` (rows of the key). Equal values are counted first. A key of few distinct values
    is ranked whole. For a larger one a quantile sketch brackets every rank, and a pass over the counts says what lies
    below the bracket and in it; brackets that still hold too many values are sketched again. Only the values of a
    bracket are ranked. A bracket that misses its rank is not used, so sketches never decide a result.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    counted = materialize(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), "counted")
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_values"))
    targets = materialize(sizes.withColumn("_t", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), expr.cast("bigint").alias("rank")) for name, expr in ranks.items()])))
        .filter((F.col("_t.rank") >= 1) & (F.col("_t.rank") <= F.col("n")))
        .select(*keys, "n", "_values", "_t.name", "_t.rank"), "ranks")

    few = (targets.filter(F.col("_values") <= rows_per_slice).groupBy(*keys, "n")
           .agg(F.collect_list(F.struct("name", "rank")).alias("_ts")))          # at most len(ranks) entries
    along = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hits = (counted.join(few, keys).withColumn("_cum", F.sum("_c").over(along))
            .withColumn("_hit", F.explode(F.filter(
                "_ts", lambda t: (t["rank"] > F.col("_cum") - F.col("_c")) & (t["rank"] <= F.col("_cum")))))
            .select(*keys, "n", "_hit.name", F.col(value).alias("_v")))
    many = targets.filter(F.col("_values") > rows_per_slice)
    if not many.isEmpty():
        hits = hits.unionByName(_bracketed(rows, counted, many, keys, value, rows_per_slice))
    return hits.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])


def _bracketed(rows: DataFrame, counted: DataFrame, targets: DataFrame, keys: list[str], value: str,
               rows_per_slice: int) -> DataFrame:
    """(keys, n, name, _v): the value at the rank of each target (keys, n, _values, name, rank) by narrowing brackets."""
    kind = counted.schema[value].dataType
    none = F.lit(None).cast(kind)
    state = targets.select(*keys, "n", "name", "rank", "_values", none.alias("_low"), none.alias("_high"),
                           F.lit(0).cast("bigint").alias("_under"), F.col("n").alias("_in"), F.lit(False).alias("_fixed"))
    held = lambda: (F.coalesce(F.col(value) >= F.col("_low"), F.lit(True)) & F.coalesce(F.col(value) <= F.col("_high"), F.lit(True)))
    target = [*keys, "name"]
    while True:
        state = materialize(state, "brackets")
        wide = state.filter(~F.col("_fixed") & (F.col("_values") > rows_per_slice))
        if wide.isEmpty():
            break
        sketch = (rows.join(wide.select(*target, "_low", "_high"), keys).filter(held())
                  .groupBy(*target).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_SIZE).alias("_s")))
        share = (F.col("rank") - F.col("_under")) / F.col("_in")
        steps = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(i / SKETCH_STEPS) for i in range(SKETCH_STEPS + 1)]))
        at = lambda step: F.get("_q", F.greatest(F.lit(0), F.least(F.lit(SKETCH_STEPS), step)).cast("int")).cast(kind)
        tried = materialize(wide.join(sketch.select(*target, steps.alias("_q")), target).select(     # sketches differ by run
            *target, "n", "rank", "_values", "_low", "_high", "_under", "_in",
            at(F.floor((share - SKETCH_ERROR) * SKETCH_STEPS)).alias("_from"), at(F.ceil((share + SKETCH_ERROR) * SKETCH_STEPS)).alias("_to")),
            "tried-brackets")
        inside = (F.col(value) >= F.col("_from")) & (F.col(value) <= F.col("_to"))
        measured = (counted.join(tried.select(*target, "_low", "_high", "_from", "_to"), keys).filter(held())
                    .groupBy(*target).agg(
                        F.coalesce(F.sum(F.when(F.col(value) < F.col("_from"), F.col("_c"))), F.lit(0)).alias("_less"),
                        F.coalesce(F.sum(F.when(inside, F.col("_c"))), F.lit(0)).alias("_now"), F.count_if(inside).alias("_left")))
        good = ((F.col("rank") > F.col("_under") + F.col("_less")) & (F.col("rank") <= F.col("_under") + F.col("_less") + F.col("_now"))
                & (F.col("_left") < F.col("_values")))
        pick = lambda new, old: F.when(good, new).otherwise(F.col(old)).alias(old)
        narrowed = tried.join(measured, target).select(
            *keys, "n", "name", "rank", pick(F.col("_left"), "_values"), pick(F.col("_from"), "_low"), pick(F.col("_to"), "_high"),
            pick(F.col("_under") + F.col("_less"), "_under"), pick(F.col("_now"), "_in"), (~good).alias("_fixed"))
        state = narrowed.unionByName(state.filter(F.col("_fixed") | (F.col("_values") <= rows_per_slice)))
    along = Window.partitionBy(*target).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counted.join(state.select(*target, "n", "rank", "_low", "_high", "_under"), keys).filter(held())
              .withColumn("_cum", F.sum("_c").over(along) + F.col("_under")))
    return (ranked.filter((F.col("rank") <= F.col("_cum")) & (F.col("rank") > F.col("_cum") - F.col("_c")))
            .select(*keys, "n", "name", F.col(value).alias("_v")))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float],
                      rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """Linearly interpolated percentiles (position share*(n-1)), exact, keys + n + one column each."""
    ranks: dict[str, Column] = {}
    for name, p in shares.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        ranks[f"_lo_{name}"] = F.floor(pos) + 1
        ranks[f"_hi_{name}"] = F.ceil(pos) + 1
    stats = order_statistics(df, keys, value, ranks, rows_per_slice)
    for name, p in shares.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        stats = stats.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos)))
    return stats.drop(*ranks)


def chunks_of_key(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], max_rows: int,
                  base_seconds: int = 60) -> DataFrame:
    """Add ``_chunk``: exactly ``max_rows`` consecutive rows of a key each (the last one fewer).
    ``at``, the first column of ``order``, is a bigint of epoch microseconds."""
    minute = F.floor(F.col(at) / F.lit(base_seconds * 1_000_000)).cast("bigint")
    placed = sliced_row_number(df, keys, minute, list(order), "_pos")
    return placed.withColumn("_chunk", F.floor((F.col("_pos") - 1) / F.lit(max_rows)).cast("bigint")).drop("_pos")


def chunked_fold(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str],
                 fold: Callable[[str | None, pd.DataFrame], tuple[pd.DataFrame, str]],
                 schema: str, max_rows: int = SLICE_ROWS, base_seconds: int = 60) -> DataFrame:
    """Exact order-dependent fold per key where no task sees more than a chunk of a key.

    ``fold(entry_state, rows_in_order) -> (output rows, exit_state)``. Keys of at most ``max_rows`` rows
    need one pass. For longer keys (there are few: rows / max_rows) all chunks run at once from a
    guessed (empty) entry state; then each chunk whose entry differs from its predecessor's exit is run
    again, until nothing changes. Each round settles at least one more chunk, so the result equals the
    sequential fold; states that soon forget their start (windows, breakers) settle in two or three
    rounds. Keys that have not settled by then only run their first stale chunk per round, which keeps
    the total work linear.
    """
    keys, order = list(keys), list(order)
    by_row = [*order]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(None, pdf.sort_values(by_row, kind="stable"))[0]

    long_keys = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                            .filter(F.col("_n") > max_rows).select(*keys), "long-keys")
    if long_keys.isEmpty():
        return df.groupBy(*keys).applyInPandas(whole, schema)
    short = df.join(long_keys, keys, "left_anti").groupBy(*keys).applyInPandas(whole, schema)
    return short.unionByName(_fold_long(df.join(long_keys, keys, "left_semi"), keys, at, by_row, fold, schema,
                                        max_rows, base_seconds))


def _fold_long(df: DataFrame, keys: list[str], at: str, by_row: list[str], fold, schema: str,
               max_rows: int, base_seconds: int) -> DataFrame:
    chunked = materialize(chunks_of_key(df, keys, at, by_row, max_rows, base_seconds), "chunks")
    group = [*keys, "_chunk"]
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunked.select(*group).schema)

    def exit_only(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(state) or not len(rows):
            return pd.DataFrame({c: [] for c in [*group, "_entry", "_exit"]})
        entry = state["_entry"].iloc[0]
        _, leaving = fold(entry if isinstance(entry, str) else None, rows.sort_values(by_row, kind="stable"))
        out = state[group].head(1).copy()
        out["_entry"], out["_exit"] = entry, leaving
        return out

    def run(states: DataFrame) -> DataFrame:
        need = chunked.join(states.select(*group), group, "left_semi")
        return need.groupBy(*group).cogroup(states.groupBy(*group)).applyInPandas(
            exit_only, f"{key_ddl}, _entry string, _exit string")

    start = chunked.select(*[F.col(c).alias(c) for c in group]).distinct().withColumn(
        "_entry", F.lit(None).cast("string"))
    states = materialize(run(start), "states")
    along = Window.partitionBy(*keys).orderBy("_chunk")
    for round_no in itertools.count():
        linked = states.withColumn("_next", F.lag("_exit").over(along))
        stale = ~F.col("_next").eqNullSafe(F.col("_entry"))
        if round_no >= FREE_ROUNDS:
            first = F.min(F.when(stale, F.col("_chunk"))).over(Window.partitionBy(*keys))
            linked = linked.withColumn("_first", first)
            if linked.filter(stale).isEmpty():
                break
            stale = F.coalesce(F.col("_chunk") == F.col("_first"), F.lit(False))
        changed = linked.filter(stale).select(*group, F.col("_next").alias("_entry"))
        if changed.isEmpty():
            break
        settled = linked.filter(~stale).select(*group, "_entry", "_exit")
        states = materialize(settled.unionByName(run(changed)), "states")

    def emit(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        entry = state["_entry"].iloc[0]
        return fold(entry if isinstance(entry, str) else None,
                    rows.drop(columns="_chunk").sort_values(by_row, kind="stable"))[0]

    return chunked.groupBy(*group).cogroup(states.groupBy(*group)).applyInPandas(emit, schema)
