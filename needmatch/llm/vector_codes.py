"""Compressed vectors: product codes found with exact integer products on float64 matrix multiplication.

Each component x becomes the integer floor(scale * x). Vectors are cut into equal consecutive parts, every part position
has a codebook, and Lloyd rounds (assign, floor of the mean) improve the codebooks before the last assignment.

Squared distances need products of integers that float64 can't hold in general. Both factors are broken into limbs so
narrow that a sum over the part's components stays within 2**53, so that each matrix product of limbs is exact; the
products are shifted and added in int64, and the first smallest distance wins. Integers so large that a distance might not
fit in int64 go the same way with Python integers for the recombination.

All passes are scans of the vectors without a shuffle of them: one finds the first codebooks, one a round adds up limbs of
the parts by codebook entry, the last writes codes. Tasks send their sums, a table of the codebooks' size, and only that
table reaches the driver; codebooks are the only broadcast besides label sums of checked size.

Defined results: rows whose vector is null, holds null or non-finite components, or has another length than the most
common one that the parts divide (ties: the shorter) take no part. A codebook starts with the vectors of the smallest
distinct keys, of a repeated key the smallest vector; with fewer keys it has fewer entries; null keys come last. Repeated
rows count as often as they stand there. An ``error`` or ``label_error`` beyond 63 bits is null. An empty table, or one
without such vectors, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK_ROWS = 4096
#: Label sums are broadcast up to this many labels; beyond, a label's rows are dealt to SALTS tasks.
MAX_BROADCAST_LABELS = 100_000
SALTS = 32


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * value), exact for a power of two; int64, or Python integers if some don't fit."""
    if not values.size or np.abs(values).max() < 2.0 ** 62 / scale:
        return np.floor(values * scale).astype(np.int64)
    whole = [math.floor(v * scale) if abs(v) < 2.0 ** 53 else int(v) * scale for v in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


def limb_width(terms: int) -> int:
    """Bits of a limb so that a sum of ``terms`` products of two limbs is at most 2**53."""
    return (53 - (terms - 1).bit_length()) // 2


def limbs(values: np.ndarray, width: int) -> list[np.ndarray]:
    """float64 arrays, lowest first, with values = sum of limb << (width * place); only the last one has signs."""
    out, one = [], 1 << width
    while values.size and (values.max() >= one or values.min() < -one):
        out.append((values & (one - 1)).astype(np.float64))
        values = values >> width
    return [*out, values.astype(np.float64)]


def roomy(dimension: int, *values: np.ndarray) -> bool:
    """Whether squared distances over ``dimension`` components of these integers fit in int64."""
    most = 1 << ((60 - (dimension - 1).bit_length()) // 2)
    return all(v.dtype != object and (not v.size or (v.max() < most and v.min() >= -most)) for v in values)


def exact_products(left: np.ndarray, right: np.ndarray, kind) -> np.ndarray:
    """left (n, d) times right (k, d) transposed, exact, as ``kind`` (int64 or object)."""
    width = limb_width(left.shape[1])
    total = np.zeros((len(left), len(right)), kind)
    theirs = limbs(right, width)
    for i, a in enumerate(limbs(left, width)):
        for j, b in enumerate(theirs):
            total += (a @ b.T).astype(np.int64).astype(kind, copy=False) << (width * (i + j))
    return total


def squares(values: np.ndarray, kind) -> np.ndarray:
    values = values.astype(kind, copy=False)
    return (values * values).sum(axis=1)


class Codebooks:
    """Entries of each part: ``entries`` (parts, k, d)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, parts) and squared distances summed over parts, of integer rows (n, parts, d)."""
        parts, _, d = self.entries.shape
        kind = np.int64 if roomy(parts * d, rows, self.entries) else object
        codes, errors = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), kind)
        for p in range(parts):
            x, c = rows[:, p], self.entries[p]
            partial = squares(c, kind)[None, :] - 2 * exact_products(x, c, kind)
            codes[:, p] = np.argmin(partial, axis=1)
            errors += squares(x, kind) + np.take_along_axis(partial, codes[:, p:p + 1], 1)[:, 0]
        return codes, errors

    def moved(self, sums: dict[int, int]) -> Codebooks:
        """Each entry replaced by the floor of its parts' mean; ``sums`` by cell, as PartSums numbers them."""
        parts, k, d = self.entries.shape
        fresh = self.entries.astype(object)
        for cell in range(parts * k):
            n = sums.get(cell * (d + 1) + d, 0)
            if n:
                fresh[cell // k, cell % k] = [sums.get(cell * (d + 1) + i, 0) // n for i in range(d)]
        small = not fresh.size or (fresh.max() < 1 << 62 and fresh.min() >= -(1 << 62))
        return Codebooks(fresh.astype(np.int64) if small else fresh)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class PartSums:
    """Sums of parts by entry, one total a limb and cell; cell (part * k + entry) * (d + 1) + position, position d counts."""

    def __init__(self, shape: tuple[int, int, int]):
        self.shape, self.totals = shape, {}

    def add(self, rows: np.ndarray, codes: np.ndarray) -> None:
        parts, k, d = self.shape
        width = limb_width(max(d, BLOCK_ROWS))
        for p in range(parts):
            chosen = (codes[:, p, None] == np.arange(k)).astype(np.float64)
            for place, limb in enumerate(limbs(rows[:, p], width)):
                total = self.totals.setdefault(place * width, np.zeros((parts, k, d + 1), np.int64))
                total[p, :, :d] += (chosen.T @ limb).astype(np.int64)
            self.totals[0][p, :, d] += chosen.sum(axis=0).astype(np.int64)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for shift, total in self.totals.items():
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array(np.full(len(cells), shift)), pa.array(total.ravel()[cells])], ["cell", "shift", "total"])


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(begin, BLOCK_ROWS)


def first_vectors(rows: DataFrame, entries: int) -> list[list[float]]:
    """Vectors of the smallest keys among those of the most common length, from one scan."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, dict] = {}         # by length: the smallest keys and their smallest vectors
        counts: dict[int, int] = {}
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            for length, n in zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True):
                counts[length] = counts.get(length, 0) + n
                own = batch.filter(pa.array(lengths == length))
                kept = least.setdefault(length, {})
                keys = own.column("key").to_pylist()
                order = [(k is None, k) for k in keys]
                limit = heapq.nsmallest(entries, {*order, *kept})[-1]
                for i in [i for i, k in enumerate(order) if k <= limit]:
                    v = own.column("v")[i].as_py()
                    kept[order[i]] = min(kept.get(order[i], v), v)
                least[length] = {k: kept[k] for k in heapq.nsmallest(entries, kept)}
        for length, kept in least.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for _, k in kept], batch.schema.field("key").type), pa.array(list(kept.values()), pa.list_(pa.float64())),
                 pa.array([length] * len(kept), pa.int32()), pa.array([counts[length], *[0] * (len(kept) - 1)], pa.int64())],
                ["key", "v", "length", "n"])

    kind = rows.schema["key"].dataType.simpleString()
    found = materialize(rows.mapInArrow(read, f"key {kind}, v array<double>, length int, n long"), "smallest-keys")
    common = found.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "length").first()
    if common is None:
        return []
    smallest = (found.where(F.col("length") == common["length"]).groupBy("key").agg(F.min("v").alias("v"))
                .orderBy(F.col("key").asc_nulls_last()).limit(entries))
    return [r["v"] for r in smallest.orderBy(F.col("key").asc_nulls_last()).collect()]


def totals(rows: DataFrame, books: Codebooks, scale: int) -> dict[int, int]:
    """Sums of the parts assigned to each entry, by cell."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, k, d = books.entries.shape

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PartSums((parts, k, d))
        for block in blocks(batches):
            whole = integers(matrix(block.column("v"), parts * d), scale).reshape(-1, parts, d)
            sums.add(whole, shared.value.nearest(whole)[0])
        yield from sums.batches()

    cells = (rows.select("v").mapInArrow(read, "cell long, shift long, total long").groupBy("cell", "shift")
             .agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect())    # as many as codebook cells
    out: dict[int, int] = {}
    for r in cells:
        out[r["cell"]] = out.get(r["cell"], 0) + (int(r["total"]) << r["shift"])
    return out


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
           max_broadcast_labels: int = MAX_BROADCAST_LABELS) -> DataFrame:
    """(key, code, error, label, label_error, codebooks_sha256) of every vector that takes part."""
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    source = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = source.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0)).where(~bad)
    kinds = {c: source.schema[c].dataType.simpleString() for c in ("key", "label")}

    first = first_vectors(rows.select("key", "v"), entries)
    dimension = len(first[0]) if first else parts
    begin = integers(np.array(first, np.float64).reshape(-1, dimension), scale)
    books = Codebooks(begin.reshape(len(first), parts, dimension // parts).transpose(1, 0, 2))
    rows = rows.where(F.size("v") == dimension)
    for _ in range(rounds if first else 0):
        books = books.moved(totals(rows, books, scale))
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            whole = integers(matrix(block.column("v"), dimension), scale).reshape(-1, parts, dimension // parts)
            codes, errors = shared.value.nearest(whole)
            ends = np.arange(len(whole) + 1, dtype=np.int32) * (2 * parts)
            text = codes.astype(np.uint8).tobytes().hex().encode()
            errors = errors if errors.dtype != object else [e if e < 1 << 63 else None for e in errors.tolist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), block.column("label"),
                 pa.StringArray.from_buffers(len(whole), pa.py_buffer(ends), pa.py_buffer(text)), pa.array(errors, pa.int64())],
                ["key", "label", "code", "error"])

    coded = materialize(rows.mapInArrow(read, f"key {kinds['key']}, label {kinds['label']}, code string, error long"), "codes")
    known = F.count("error") == F.count(F.lit(1))
    sums = materialize(coded.groupBy("label").agg(
        F.when(known, F.sum(F.col("error").cast("decimal(20,0)")).try_cast("bigint")).alias("label_error")), "label-errors")
    sums = sums.select(F.col("label").alias("of"), "label_error")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= max_broadcast_labels:
        joined = coded.join(F.broadcast(sums), same)
    else:
        dealt = coded.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)).cast("int"))
        copies = sums.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(copies, same & (F.col("salt") == F.col("copy")))
    return joined.select(F.col("key").alias(key), "code", "error", F.col("label").alias(label), "label_error",
                         F.lit(books.sha256()).alias("codebooks_sha256"))
