"""Near duplicates by SimHash fingerprints and a generalised pigeonhole join.

A fingerprint bit is 1 if it is set in over half of the 64-bit hashes of a text's shingles (repeats included). Equal
fingerprints form a class first, so copies are never paired; the rest works on distinct fingerprints.

The 64 bits are grouped into four blocks of 16 such that correlated bits share a block (greedily, by the correlations
over all fingerprints), and a layout joins blocks to partitions. By the generalised pigeonhole principle, with thresholds
t_1 .. t_m that add up to limit - m + 1, two fingerprints within the limit differ by at most t_i bits in some partition i;
-1 leaves a partition out. Each fingerprint takes the thresholds of its own least estimated cost: dynamic programming over
partitions and what is left of the sum, where a threshold costs the keys in its Hamming ball and the fingerprints expected
there. The expectation comes from counts of all 65,536 values of each block over all fingerprints, blocks of one partition
taken as independent. Frequent values thus get small thresholds or none, and rare ones the large ones. The layout is the
one with the least total cost over all fingerprints.

Every fingerprint is posted under its value in each partition and probes with its own balls: one equi join, whose
candidates are verified by counting the bits of their difference inside the join, so only links become rows.

Defined results: a null text, or one without words, has fingerprint zero and is linked like any other; a text with fewer
words than the width has the whole sequence as its one shingle; repeated rows get the same result; null keys take part,
and a component that holds nothing else has a null id; an empty table gives no rows; other columns are ignored. Ties of
equal costs go to the first layout or threshold. Texts are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .components import components
from .words import slices

WIDTH = 3
LIMIT = 2
SEED = 42
BLOCKS = 4
BLOCK_BITS = 16
#: Blocks joined to partitions; all are weighed, and the cheapest one is used.
LAYOUTS = (((0,), (1,), (2,), (3,)), ((0,), (1,), (2, 3)), ((0, 1), (2, 3)), ((0, 1, 2, 3),))
#: Cost of a key to probe, in candidates to verify.
PROBE_COST = 1.5
#: A class with more than this part of all documents finds its component by a broadcast, which has 1 / HOT_SHARE rows at most.
HOT_SHARE = 1e-4
#: Hashes whose bits are unpacked at once.
HASHES = 1 << 15


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, lowest first."""
    total = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), HASHES):
        part = hashes[begin:begin + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    words = text.lower().split()        # both know ASCII only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-1]])
    count = max(1, len(words) - width + 1)
    cuts = map(slice, begins[:count].tolist(), (ends[-count:] - 1).tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(whole.__getitem__, cuts), itertools.repeat(seed)), np.uint64, count)
    return int(np.packbits(2 * bit_counts(hashes) > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, print): the fingerprint of every row as a signed long."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.array(found, np.uint64).view(np.int64))],
                                             ["key", "print"])

    return source.mapInArrow(read, f"key {kind}, print long")


def unpacked(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bits_together(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many of them have both bits of each pair set."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            bits = unpacked(batch.column(0).to_numpy()).astype(np.float32)      # a batch is far below 2**24 rows
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        cells = np.concatenate([both.ravel(), [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    rows = prints.mapInArrow(read, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()    # 4,097 rows
    cells = np.zeros(64 * 64 + 1, np.int64)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray) -> np.ndarray:
    """Bits by block (BLOCKS, BLOCK_BITS): a block starts with the most correlated pair left and takes the bit with the
    largest mean correlation to it until it is full."""
    share = both / max(n, 1)
    one = np.diag(share)
    spread = np.sqrt(np.outer(one * (1 - one), one * (1 - one)))
    close = np.abs(np.divide(share - np.outer(one, one), spread, out=np.zeros_like(share), where=spread > 0))
    np.fill_diagonal(close, -1)
    left, out = list(range(64)), []
    for _ in range(BLOCKS):
        among = close[np.ix_(left, left)]
        i, j = np.unravel_index(np.argmax(among), among.shape)
        block = [left[i], left[j]]
        while len(block) < BLOCK_BITS:
            rest = [b for b in left if b not in block]
            block.append(rest[int(np.argmax(close[np.ix_(rest, block)].mean(axis=1)))])
        left = [b for b in left if b not in block]
        out.append(sorted(block))
    return np.array(out)


def block_values(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(rows, BLOCKS): the bits of each block as a number."""
    own = unpacked(prints)
    weights = 1 << np.arange(BLOCK_BITS, dtype=np.int64)
    return np.stack([own[:, block].astype(np.int64) @ weights for block in bits], axis=1)


def value_counts(prints: DataFrame, bits: np.ndarray) -> np.ndarray:
    """(BLOCKS, 65,536): fingerprints with each value of a block."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = block_values(batch.column(0).to_numpy(), bits) + (np.arange(BLOCKS) << BLOCK_BITS)
            cells, n = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

    rows = prints.mapInArrow(read, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()   # 2**18 rows at most
    out = np.zeros(BLOCKS << BLOCK_BITS)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out.reshape(BLOCKS, -1)


def masks(width: int, errors: int) -> list[int]:
    """Numbers of ``width`` bits with exactly so many set."""
    return [sum(1 << b for b in chosen) for chosen in itertools.combinations(range(width), errors)]


class Plan:
    """Thresholds by dynamic programming: shares[e][block, value] is the part of all fingerprints whose value of the block
    differs from this one by exactly e bits."""

    def __init__(self, bits: np.ndarray, counts: np.ndarray, limit: int = LIMIT):
        self.bits, self.limit, self.total = bits, limit, counts[0].sum()
        value = np.arange(1 << BLOCK_BITS)
        share = counts / max(self.total, 1)
        self.shares = [sum(share[:, value ^ m] for m in masks(BLOCK_BITS, e)) for e in range(limit + 1)]

    def expected(self, values: np.ndarray, partition: tuple[int, ...]) -> np.ndarray:
        """(rows, limit + 1): part of all fingerprints that differ by exactly e bits in the partition."""
        known = np.zeros((len(values), self.limit + 1))
        known[:, 0] = 1
        for block in partition:
            own = [s[block, values[:, block]] for s in self.shares]
            known = np.stack([sum(known[:, e - i] * own[i] for i in range(e + 1)) for e in range(self.limit + 1)], axis=1)
        return known

    def allocate(self, values: np.ndarray, layout) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds (rows, partitions) of the least cost, and that cost."""
        rows, m = len(values), len(layout)
        # used[s]: least cost so far with thresholds + 1 that add up to s; all of them to limit + 1
        used = np.full((self.limit + 2, rows), np.inf)
        used[0] = 0
        taken = np.zeros((m, self.limit + 2, rows), np.int8)
        for i, partition in enumerate(layout):
            width = BLOCK_BITS * len(partition)
            ball = np.cumsum([len(masks(width, e)) for e in range(self.limit + 1)])
            cost = [np.zeros(rows), *(PROBE_COST * ball[:, None] + self.total * np.cumsum(self.expected(values, partition), axis=1).T)]
            fresh = np.full_like(used, np.inf)
            for s in range(self.limit + 2):
                for step in range(s + 1):
                    total = used[s - step] + cost[step]
                    better = total < fresh[s]
                    fresh[s][better], taken[i, s][better] = total[better], step
            used = fresh
        out, at = np.zeros((rows, m), np.int64), np.full(rows, self.limit + 1)
        for i in range(m - 1, -1, -1):
            step = taken[i, at, np.arange(rows)]
            out[:, i], at = step - 1, at - step
        return out, used[self.limit + 1]

    def partition_values(self, values: np.ndarray, partition: tuple[int, ...]) -> np.ndarray:
        return sum(values[:, b] << (BLOCK_BITS * i) for i, b in enumerate(partition))


def cheapest_layout(prints: DataFrame, plan: Plan) -> int:
    shared = prints.sparkSession.sparkContext.broadcast(plan)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = block_values(batch.column(0).to_numpy(), shared.value.bits)
            costs = [float(shared.value.allocate(values, layout)[1].sum()) for layout in LAYOUTS]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(LAYOUTS)), pa.int32()), pa.array(costs)], ["layout", "cost"])

    costs = prints.mapInArrow(read, "layout int, cost double").groupBy("layout").agg(F.sum("cost").alias("cost")).collect()
    return min((r["cost"], r["layout"]) for r in costs)[1]


def links(prints: DataFrame, limit: int = LIMIT, layout: int | None = None) -> DataFrame:
    """(a, b), a < b: distinct fingerprints (column ``print``) that differ by ``limit`` bits or fewer."""
    spark = prints.sparkSession
    if prints.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    bits = grouped_bits(*bits_together(prints))
    plan = Plan(bits, value_counts(prints, bits), limit)
    chosen = LAYOUTS[cheapest_layout(prints, plan) if layout is None else layout]
    shared = spark.sparkContext.broadcast(plan)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = block_values(batch.column(0).to_numpy(), shared.value.bits)
            for i, partition in enumerate(chosen):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), i, np.int32)), pa.array(shared.value.partition_values(values, partition)),
                     batch.column(0)], ["part", "value", "b"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [[np.array(masks(BLOCK_BITS * len(p), e), np.uint64).view(np.int64) for e in range(limit + 1)] for p in chosen]
        for batch in batches:
            own = batch.column(0).to_numpy()
            values = block_values(own, shared.value.bits)
            thresholds, _ = shared.value.allocate(values, chosen)
            for i, partition in enumerate(chosen):
                keys = shared.value.partition_values(values, partition)
                for e in range(limit + 1):
                    at = np.flatnonzero(thresholds[:, i] >= e)
                    step = max(1, (1 << 18) // len(flips[i][e]))
                    for begin in range(0, len(at), step):
                        some = at[begin:begin + step]
                        asked = (keys[some][:, None] ^ flips[i][e][None, :]).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(asked), i, np.int32)), pa.array(asked),
                             pa.array(np.repeat(own[some], len(flips[i][e])))], ["part", "value", "a"])

    posted = prints.select("print").mapInArrow(post, "part int, value long, b long")
    asked = prints.select("print").mapInArrow(probe, "part int, value long, a long")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit
    same = [posted["part"] == asked["part"], posted["value"] == asked["value"], F.col("a") != F.col("b"), near]
    met = asked.join(posted, same)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, limit: int = LIMIT,
                    layout: int | None = None, hot_share: float = HOT_SHARE) -> DataFrame:
    """(key, fingerprint, component_id) of every row; component_id is the smallest key reachable by links."""
    rows = materialize(fingerprints(docs, key, text, width), "fingerprints")
    classes = materialize(rows.groupBy("print").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    found = components(links(classes.select("print"), limit, layout))

    placed = classes.join(found.withColumnRenamed("node", "print"), "print", "left")
    alone = placed.where(F.col("comp").isNull()).select("print", "n", F.col("least").alias("component_id"))
    linked = materialize(placed.where(F.col("comp").isNotNull()).select("print", "n", "least", "comp"), "linked-classes")
    smallest = linked.groupBy("comp").agg(F.min("least").alias("component_id"))
    # the classes of a large component meet its id in several tasks
    salt = F.pmod(F.xxhash64("print"), F.lit(16)).cast("int")
    copies = smallest.select("comp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    joined = linked.withColumn("salt", salt).join(copies, ["comp", "salt"]).select("print", "n", "component_id")
    ids = materialize(alone.unionByName(joined), "component-ids")

    # classes with a large part of all documents are few: their rows don't go through the shuffle
    least = rows.count() * hot_share
    hot = F.broadcast(ids.where(F.col("n") > least).select("print", F.struct("component_id").alias("hot")))
    marked = rows.join(hot, "print", "left")
    usual = ids.where(F.col("n") <= least).select("print", "component_id")
    direct = marked.where(F.col("hot").isNotNull()).select("key", "print", "hot.component_id")
    rest = marked.where(F.col("hot").isNull()).select("key", "print").join(usual, "print")
    return direct.unionByName(rest).select(F.col("key").alias(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
                                           "component_id")
