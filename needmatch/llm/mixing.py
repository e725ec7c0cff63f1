"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words, so each of its documents should be copied target / size times on average.
The whole part of that number is sure; the fractions are rounded together. Mass (words times fraction) moves within a
pair, at random but without bias, until one side is integral; the sum stays. Groups of bounded size pair each document,
largest first, with the pool of all smaller ones, which share one fraction; so what stays open is small. Each group
hands its open document up a reduction tree, where open documents are paired two by two. No source is ever gathered in
one task, and a source ends at most one document away from its target.

Equal rows (same key, source and text) are one unit of the tree. Its copies are counted first: of rows * fraction the
whole part is sure, and only the remainder is rounded, with the mass of one document. So a unit of any size moves its
source by one document at most.

Targets: sources in order of their names, null last, weigh ``weights`` in turn and share the words of all documents;
a target stops at ``most`` times its source's size, and the excess goes to the others by weight until none is above.

Defined results: a null text has no words; documents without words get their whole copies only; of equal rows, which
are interchangeable, some are copied once more than the others; an empty table gives no rows; other columns are
ignored. All counts follow from row contents and the seed, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .words import SPACE

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
GROUP_ROWS = 8192
FAN_IN = 256
BLOCK_COPIES = 4096
UNIT = "source string, key string, content long, rows long, size long, sure long"
STATE = f"bucket long, {UNIT}, fraction double, extra int"


def word_count(text) -> F.Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Filling stops at a common level: the sources whose limit per weight is lowest are full, and the others share what
    is left by weight. Windows run over sources, never over documents.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = (ranked.withColumn("weight", F.element_at(listed, (F.col("rank") % len(weights) + 1).cast("int")))
               .withColumn("limit", most * F.col("source_size"))
               .withColumn("fills", F.col("limit") / F.col("weight")))
    order = Window.orderBy("fills", "rank")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = weighed.withColumn(
        "level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(full), F.lit(0.0)))
        / F.sum("weight").over(rest))
    # the first source, in order of filling, whose limit isn't reached fixes the level of all after it
    settled = level.withColumn(
        "settled", F.min(F.when(F.col("fills") >= F.col("level"), F.struct("fills", "rank", "level"))).over(everything))
    return settled.select(
        "source", "source_size",
        F.when(F.col("settled").isNull() | (F.col("fills") < F.col("settled.level")), F.col("limit"))
        .otherwise(F.col("weight") * F.col("settled.level")).alias("target"))


def transfer(a: float, p: float, b: float, q: float, draw: float) -> tuple[float, float, bool, bool]:
    """Moves mass between two sides with masses a, b and fractions p, q; gives both fractions, and which is integral."""
    to_first, to_second = min((1.0 - p) * a, q * b), min(p * a, (1.0 - q) * b)
    if draw * (to_first + to_second) < to_second:
        first, second = (1.0 - p) * a <= q * b, q * b <= (1.0 - p) * a
        return (1.0 if first else p + to_first / a), (0.0 if second else q - to_first / b), first, second
    first, second = p * a <= (1.0 - q) * b, (1.0 - q) * b <= p * a
    return (0.0 if first else p - to_second / a), (1.0 if second else q + to_second / b), first, second


def pool_rounding(masses: np.ndarray, fraction: float, draws: np.ndarray) -> np.ndarray:
    """Rounds documents of one common fraction, in order: each is paired with the pool of all after it.

    Gives fractions of which at most one isn't 0 or 1.
    """
    out = np.full(len(masses), fraction)
    pools = np.concatenate([np.cumsum(masses[::-1])[::-1][1:], [0.0]])
    for j, (a, pool, draw) in enumerate(zip(masses.tolist(), pools.tolist(), draws.tolist(), strict=True)):
        if fraction in (0.0, 1.0) or not pool:
            out[j:] = fraction
            break
        out[j], fraction, _, emptied = transfer(a, fraction, pool, fraction, draw)
        if emptied:
            out[j + 1:] = fraction
            break
    return out


def pair_rounding(masses: np.ndarray, fractions: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rounds documents of different fractions, in order: the open one is paired with the next.

    Gives fractions of which at most one isn't 0 or 1.
    """
    out, held = fractions.copy(), -1
    for j, draw in enumerate(draws.tolist()):
        if out[j] in (0.0, 1.0):
            continue
        if held < 0:
            held = j
            continue
        out[held], out[j], first, second = transfer(masses[held], out[held], masses[j], out[j], draw)
        held = -1 if first and second else j if first else held
    return out


def _rounding(seed: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "content"], ascending=[False, True, True], na_position="last",
                              ignore_index=True)
        first = pdf.iloc[0]
        name = f"{seed}|{level}|{first['bucket']}|{first['source']}"
        generator = np.random.default_rng(xxhash.xxh3_64_intdigest(name))
        draws = generator.random(len(pdf))
        masses, fractions = pdf["size"].to_numpy(float), pdf["fraction"].to_numpy(float)
        if not level:       # single rows share one fraction; units of equal rows have their own remainders
            single = pdf["rows"].to_numpy() == 1
            if single.any():
                fractions[single] = pool_rounding(masses[single], float(fractions[single][0]), draws[single])
            draws = generator.random(len(pdf))
        fractions = pair_rounding(masses, fractions, draws)
        extra = np.where(np.isin(fractions, (0.0, 1.0)), fractions, -1.0).astype(np.int32)
        return pdf.assign(extra=extra, fraction=fractions)
    return run


def round_together(units: DataFrame, widest: int, seed: int) -> list[DataFrame]:
    """Settled units of each level of the reduction tree; ``units`` has the columns of STATE but extra, and one
    fraction for all single rows of a source."""
    settled, level = [], 0
    rows = units.withColumn("extra", F.lit(-1))
    while True:
        rows = materialize(rows.groupBy("source", "bucket").applyInPandas(_rounding(seed, level), STATE), "mixing")
        settled.append(rows.where("extra >= 0"))
        rows = rows.where("extra < 0")
        if widest <= 1:
            break
        widest, level = -(-widest // FAN_IN), level + 1
        rows = rows.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    # the tree's root: one open unit a source, settled by a draw of its own
    draw = F.pmod(F.xxhash64(F.lit(seed), "source", "key", "content"), F.lit(1 << 30)) / float(1 << 30)
    return [*settled, rows.withColumn("extra", (draw < F.col("fraction")).cast("int"))]


def mixed_units(docs: DataFrame, key: str, text: str, source: str, weights, most: float, seed: int,
                group_rows: int) -> DataFrame:
    """(key, source, content, rows, size, source_size, target, least, more) of every unit of equal rows; content hashes
    the text. ``more`` of a unit's rows are copied ``least`` + 1 times, the others ``least`` times."""
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(source).cast("string").alias("source"),
                       F.xxhash64(F.col(text).cast("string")).alias("content"),
                       word_count(F.col(text).cast("string")).alias("size"))
    units = materialize(rows.groupBy("source", "key", "content", "size").agg(F.count("*").alias("rows")), "mixing-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"),
                                        F.count("*").alias("units"))
    # one row a source, written once: the same targets hold for every later step
    targets = materialize(source_targets(sizes.select("source", "source_size"), weights, most)
                          .join(sizes.select(F.col("source").alias("same"), "units"), F.col("source").eqNullSafe(F.col("same")))
                          .drop("same"), "mixing-targets")
    by_source = targets.withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    buckets = F.ceil(F.col("units") / group_rows)
    wanted = F.col("rows") * (F.col("ratio") - F.floor("ratio"))
    worded = (units.where("size > 0").join(by_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")
              .withColumn("ratio", ratio).withColumn("wanted", wanted)
              .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key", "content"), buckets).cast("long"))
              .select("bucket", "source", "key", "content", "rows", "size", F.floor("wanted").cast("long").alias("sure"),
                      (F.col("wanted") - F.floor("wanted")).alias("fraction")))
    widest = targets.agg(F.max(F.ceil(F.col("units") / group_rows))).first()[0] or 0
    settled = round_together(worded, widest, seed)
    unit = ["source", "key", "content", "rows", "size"]
    chosen = units.where("size = 0").select(*unit, F.lit(0).cast("long").alias("more"))
    for level in settled:
        chosen = chosen.unionByName(level.select(*unit, (F.col("sure") + F.col("extra")).cast("long").alias("more")))
    return (chosen.join(by_source, F.col("source").eqNullSafe(F.col("of")))
            .select("key", "source", "content", "rows", "size", "source_size", "target",
                    F.floor(ratio).cast("long").alias("least"), "more"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        most: float = MOST, seed: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, source, content, size, source_size, target, copies, taken) of every row; content hashes its text."""
    kind = docs.schema[key].dataType
    units = mixed_units(docs, key, text, source, weights, most, seed, group_rows)
    # rows of a unit come from blocks of BLOCK_COPIES numbers; blocks of large units are dealt to all tasks
    blocks = units.withColumn("_block", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / BLOCK_COPIES).cast("long"))))
    large = blocks.where(F.col("rows") > BLOCK_COPIES).repartition("key", "content", "_block")
    begin = F.col("_block") * BLOCK_COPIES + 1
    number = F.explode(F.sequence(begin, F.least(F.col("rows"), begin + BLOCK_COPIES - 1)))
    copies = F.col("least") + (F.col("_number") <= F.col("more")).cast("long")
    return (blocks.where(F.col("rows") <= BLOCK_COPIES).unionByName(large).withColumn("_number", number)
            .withColumn("copies", copies)
            .select(F.col("key").cast(kind).alias(key), F.col("source").alias(source), "content", "size",
                    "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def numbered(rows: DataFrame, unit: list[str], name: str) -> DataFrame:
    """Adds column ``name``: the place of each row in its unit, from 1, in the order of a table written here.

    A unit's rows are counted per partition and then numbered within it, so none is gathered in one task.
    """
    rows = materialize(rows.withColumn(name, F.monotonically_increasing_id()), "mixing-equal-rows")
    part = F.shiftright(F.col(name), 33)
    rows = rows.withColumn(f"{name}_part", part)
    same = [F.col(c).alias(f"{name}_{i}") for i, c in enumerate(unit)]
    counts = rows.groupBy(*same, F.col(f"{name}_part").alias(f"{name}_of")).agg(F.count("*").alias(f"{name}_n"))
    before = Window.partitionBy(*[f"{name}_{i}" for i in range(len(unit))]).orderBy(f"{name}_of").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.withColumn(f"{name}_start", F.coalesce(F.sum(f"{name}_n").over(before), F.lit(0)))
    meet = F.col(f"{name}_part") == F.col(f"{name}_of")
    for i, c in enumerate(unit):
        meet = meet & F.col(c).eqNullSafe(F.col(f"{name}_{i}"))
    within = F.row_number().over(Window.partitionBy(*unit, f"{name}_part").orderBy(name))
    kept = [c for c in rows.columns if c not in (name, f"{name}_part")]
    return (rows.withColumn(f"{name}_place", within).join(starts, meet)
            .select(*kept, (F.col(f"{name}_start") + F.col(f"{name}_place")).alias(name)))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
               most: float = MOST, seed: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of the mix: every row of ``docs`` as often as it is copied, with its columns as they were, whatever
    their names."""
    plan = materialize(mixed_units(docs, key, text, source, weights, most, seed, group_rows)
                       .select(F.col("key").alias("_key"), F.col("source").alias("_source"),
                               F.col("content").alias("_content"), "rows", "least", "more")
                       .where("least + more > 0"), "mixing-plan")
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    own = [F.col(f"row.`{key}`").cast("string"), F.col(f"row.`{source}`").cast("string"),
           F.xxhash64(F.col(f"row.`{text}`").cast("string"))]

    def meet(units: DataFrame) -> DataFrame:
        return whole.join(units, own[0].eqNullSafe(F.col("_key")) & own[1].eqNullSafe(F.col("_source"))
                          & (own[2] == F.col("_content")))

    alike = plan.where((F.col("more") == 0) | (F.col("more") == F.col("rows")))
    split = plan.where((F.col("more") > 0) & (F.col("more") < F.col("rows")))
    taken = meet(alike).select("row", (F.col("least") + (F.col("more") > 0).cast("long")).alias("copies"))
    if not split.isEmpty():
        places = numbered(meet(split), ["_key", "_source", "_content"], "place")
        taken = taken.unionByName(places.select(
            "row", (F.col("least") + (F.col("place") <= F.col("more")).cast("long")).alias("copies")))
    return (taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("row.*"))
