"""Near copies by a size-aware heavy-light Jaccard join of shingle sets.

Documents with equal sets form a class first, so copies are never paired. The sets' shingles have one global order, rare
ones first. By the prefix principle two sets that link share k of their first n - ceil(0.85 n) + k shingles; sets up to
a boundary size (light) post every 2-subset of their 2-prefix, larger ones (heavy) and those that can link to them post
the single shingles of their 1-prefix. The boundary is the one with the least estimated cost: subsets to enumerate
against lists to scan.

A signature carries its room: how many shingles the set can share with another whose first common shingles are these.
What stands before them in the order is not in the other set, so a pair on a list is a candidate there only if the
smaller room is enough for a link; linked sets always meet on the list of their first common shingles.

Links are needed only as far as they connect. Round one verifies each class against one hub of the lists it is on, the
member with the most room, which is the one with the fewest shingles of its own; round two verifies every candidate pair
whose classes are still in different components, after exact bounds on size, room and a sketch of bucket counts. So a
large group of near copies costs about one pair a member, and no link is lost between components.

Order of shingles: only counts of shingles that a block of texts holds twice are added up, and those above the larger of
MIN_HEAVY and 2**-20 of all shingles count as frequent; that table has 2**20 rows at most and is broadcast. Any order
gives the same result.

Defined results: a null text, or one without words, has an empty set and is its own component; a text with fewer words
than the width has the whole sequence as its one shingle; repeated rows get the same result; an empty table gives no
rows; other columns are ignored. Shingles and sets are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize
from .components import components
from .words import Words, mixed, slices, window_hashes

WIDTH = 4
PERCENT = 85
MIN_HEAVY = 32
HEAVY_SHARE = 2.0 ** -20
BUCKETS = 256
SCAN_COST = 3.0
BOUNDARIES = (0, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Classes to verify are found in the documents by a broadcast up to this many keys, by a shuffle beyond.
MAX_BROADCAST_KEYS = 1_000_000


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


class ShingleSets:
    """Distinct shingles of each text of a block: ``values`` sorted by text, ``frequency`` class and hash."""

    def __init__(self, texts: pa.Array, width: int, frequent: tuple[np.ndarray, np.ndarray] | None = None):
        words = Words(texts, lower=True)
        hashes = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        lengths, owner = words.lengths(), words.owner()
        windows = window_hashes(hashes, width)
        inside = owner[:len(windows)] == owner[width - 1:] if len(windows) else np.zeros(0, bool)
        values, of = windows[inside], owner[:len(windows)][inside]
        short = np.flatnonzero((lengths > 0) & (lengths < width))
        whole = [window_hashes(hashes[words.starts[i]:words.starts[i + 1]], int(lengths[i]))[0] + np.uint64(lengths[i])
                 for i in short.tolist()]
        values = mixed(np.concatenate([values, np.array(whole, np.uint64)]))
        of = np.concatenate([of, short])
        rank = np.zeros(len(values), np.uint8)
        if frequent is not None and len(frequent[0]):
            at = np.minimum(np.searchsorted(frequent[0], values), len(frequent[0]) - 1)
            rank = np.where(frequent[0][at] == values, frequent[1][at], 0).astype(np.uint8)
        order = np.lexsort((values, rank, of))
        values, of = values[order], of[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        self.values, self.owner = values[new], of[new]
        self.sizes = np.bincount(self.owner, minlength=len(texts)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def classes(self) -> np.ndarray:
        """One hash for each set; 0 for empty ones."""
        with np.errstate(over="ignore"):
            each = mixed(self.values ^ np.uint64(0x5851F42D4C957F2D))
            added = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
            total = added[self.starts[1:]] - added[self.starts[:-1]]
        return np.where(self.sizes > 0, mixed(total + self.sizes.astype(np.uint64)), np.uint64(0))

    def sketch(self, i: int) -> bytes:
        """How many shingles fall into each bucket, as 16-bit counts that stop at the largest."""
        own = self.values[self.starts[i]:self.starts[i + 1]]
        counts = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
        return np.minimum(counts, 65535).astype("<u2").tobytes()

    def signatures(self, i: int, boundary: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a set and the room of each."""
        own, n = self.values[self.starts[i]:self.starts[i + 1]], int(self.sizes[i])
        least = -(-percent * n // 100)
        if least == n and n * 100 // percent <= n:      # no set of another size, or other content, can link
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts, rooms = [], []
        if 100 * n > percent * boundary:
            parts.append(mixed(own[:n - least + 1]))
            rooms.append(n - np.arange(len(parts[-1])))
        if n <= boundary:
            prefix = own[:n - least + 2]
            first, second = np.triu_indices(len(prefix), 1)
            with np.errstate(over="ignore"):
                parts.append(mixed(prefix[first] * np.uint64(0x9E3779B97F4A7C15) + mixed(prefix[second])))
            rooms.append(n - second + 1)
        return np.concatenate(parts), np.concatenate(rooms)


def prefix_length(n: int, k: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + k)


def cheapest_boundary(sizes: list[tuple[int, int]], percent: int) -> int:
    """Of BOUNDARIES the one with the least cost; ``sizes`` has (set size, classes of that size)."""
    def cost(boundary: int) -> float:
        total = 0.0
        for n, classes in sizes:
            if n <= boundary:
                p = prefix_length(n, 2, percent)
                total += classes * p * (p - 1) / 2
            if 100 * n > percent * boundary:
                total += classes * SCAN_COST * prefix_length(n, 1, percent)
        return total
    return min(BOUNDARIES, key=lambda b: (cost(b), b))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def classified(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n, class) of every row."""
    source = _texts(docs, key, text)
    kind = source.schema["key"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = ShingleSets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets.sizes), signed(sets.classes())],
                                             ["key", "n", "class"])

    return source.mapInArrow(read, f"key {kind}, n long, class long")


def frequent_shingles(docs: DataFrame, key: str, text: str, width: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles and their frequency classes (powers of two), 1 / HEAVY_SHARE at most."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = ShingleSets(batch.column("text"), width)
            _, first = np.unique(sets.classes(), return_index=True)     # copies in a block count once
            own = sets.values[np.isin(sets.owner, first)]
            values, counts = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(values[counts > 1]), pa.array(counts[counts > 1])], ["shingle", "n"])

    least = max(MIN_HEAVY, int(total * HEAVY_SHARE) + 1)
    rows = (_texts(docs, key, text).mapInArrow(read, "shingle long, n long").groupBy("shingle")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            .select("shingle", F.floor(F.log2("n")).cast("int").alias("rank")).toPandas())
    hashes = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["rank"].to_numpy(np.uint8)[order]


def signed_sets(docs: DataFrame, key: str, text: str, width: int, boundary: int, percent: int, frequent) -> DataFrame:
    """(class, n, sketch, signatures, rooms), one row a class."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = ShingleSets(batch.column("text"), width, shared.value)
            classes = sets.classes()
            _, first = np.unique(classes, return_index=True)
            lists = [(i, sets.signatures(i, boundary, percent)) for i in first.tolist() if sets.sizes[i]]
            lists = [(i, *s) for i, s in lists if len(s[0])]
            at = np.array([i for i, _, _ in lists], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint64), *[s for _, s, _ in lists]])
            rooms = np.concatenate([np.zeros(0, np.int64), *[r for _, _, r in lists]]).astype(np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for _, s, _ in lists])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [signed(classes[at]), pa.array(sets.sizes[at]), pa.array([sets.sketch(i) for i in at.tolist()], pa.binary()),
                 pa.ListArray.from_arrays(ends, signed(flat)), pa.ListArray.from_arrays(ends, pa.array(rooms))],
                ["class", "n", "sketch", "signatures", "rooms"])

    schema = "class long, n long, sketch binary, signatures array<long>, rooms array<int>"
    return _texts(docs, key, text).mapInArrow(read, schema).dropDuplicates(["class"])


def compatible(n, m, percent: int) -> F.Column:
    return (100 * F.least(n, m)) >= percent * F.greatest(n, m)


@F.arrow_udf(T.LongType())
def bucket_bound(left: pa.Array, right: pa.Array) -> pa.Array:
    """The most shingles that two sets can share by their sketches."""
    out = []
    for a, b in zip(left, right, strict=True):
        x, y = (np.frombuffer(v.as_buffer(), "<u2").astype(np.int64) for v in (a, b))
        least = np.minimum(x, y)
        out.append(int(least.sum()) if least.max() < 65535 else 1 << 40)
    return pa.array(out, pa.int64())


@F.arrow_udf(T.LongType())
def shared_shingles(left: pa.Array, right: pa.Array) -> pa.Array:
    out = [len(np.intersect1d(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8"), assume_unique=True))
           for a, b in zip(left, right, strict=True)]
    return pa.array(out, pa.int64())


def linked(shared, n, m, percent: int) -> F.Column:
    """percent / 100 of the union at least."""
    return 100 * shared >= percent * (n + m - shared)


def whole_sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame, holders: DataFrame) -> DataFrame:
    """(class, shingles) of the wanted classes; their texts are found by the key of one holder."""
    keys = wanted.join(holders, "class").select(F.col("holder").alias("wanted")).distinct()
    texts = _texts(docs, key, text)
    keys = F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = ShingleSets(batch.column("text"), width)
            cuts = zip(sets.starts[:-1].tolist(), sets.starts[1:].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [signed(sets.classes()), pa.array([sets.values[a:b].astype("<u8").tobytes() for a, b in cuts], pa.binary())],
                ["class", "shingles"])

    return (texts.join(keys, F.col("key").eqNullSafe(F.col("wanted")), "left_semi").select("text")
            .mapInArrow(read, "class long, shingles binary").dropDuplicates(["class"]))


class Verifier:
    """Exact links among candidate pairs (a, b, n, m) of classes; ``sketches`` has (class, sketch)."""

    def __init__(self, docs, key, text, width, percent, holders, sketches):
        self.texts, self.holders, self.sketches, self.percent = (docs, key, text, width), holders, sketches, percent

    def _both(self, pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(table.select(F.col("class").alias(side), F.col(value).alias(f"{value}_{side}")), side)
        return pairs

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs that the sketches don't rule out."""
        bound = bucket_bound("sketch_a", "sketch_b")
        return self._both(pairs, self.sketches, "sketch").where(linked(bound, F.col("n"), F.col("m"), self.percent)).select(*pairs.columns)

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that link; ``pairs`` is a written table."""
        docs, key, text, width = self.texts
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        sets = materialize(whole_sets(docs, key, text, width, wanted, self.holders), "shingle-sets")
        shared = shared_shingles("shingles_a", "shingles_b")
        return self._both(pairs, sets, "shingles").where(linked(shared, F.col("n"), F.col("m"), self.percent)).select("a", "b")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, class, component_id) of every row; component_id is the smallest key reachable by links."""
    rows = materialize(classified(docs, key, text, width), "shingle-classes")
    full = rows.where("n > 0")
    holders = full.groupBy("class").agg(F.min("key").alias("holder"), F.max("n").alias("n"))
    # sizes are grouped beyond 1000 shingles: far above any boundary
    sizes = holders.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("classes")).collect()
    boundary = cheapest_boundary([(r["n"], r["classes"]) for r in sizes], percent)
    total = full.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    sets = materialize(signed_sets(docs, key, text, width, boundary, percent,
                                   frequent_shingles(docs, key, text, width, total)), "signatures")
    lists = sets.select(F.inline(F.arrays_zip(F.col("signatures").alias("sig"), F.col("rooms").alias("room"))), "class", "n")
    # lists with one class link nothing
    hub = F.max_by(F.struct("class", "n", "room"), F.struct(F.col("room") / F.col("n"), F.col("class")))
    hubs = (lists.groupBy("sig").agg(hub.alias("hub"), F.min("class").alias("first"), F.max("class").alias("last"))
            .where("first < last").select("sig", "hub"))
    posted = materialize(lists.join(hubs, "sig"), "posted")
    check = Verifier(docs, key, text, width, percent, holders, sets.select("class", "sketch"))

    starred = (posted.where(F.col("class") != F.col("hub.class"))
               .where(compatible(F.col("n"), F.col("hub.n"), percent)
                      & linked(F.least("room", "hub.room"), F.col("n"), F.col("hub.n"), percent))
               .groupBy(F.col("class").alias("b"), F.col("hub.class").alias("a"))
               .agg(F.count("*").alias("common"), F.first("hub.n").alias("n"), F.first("n").alias("m"))
               .groupBy("b").agg(F.max_by(F.struct("a", "n", "m"), F.struct("common", "a")).alias("p"))
               .select("p.a", "b", "p.n", "p.m"))
    links = materialize(check.links(materialize(check.likely(starred), "star-pairs")), "star-links")
    mapped = components(links)

    spot = (posted.join(mapped.withColumnRenamed("node", "class"), "class", "left")
            .select("sig", "room", "class", "n", F.coalesce("comp", "class").alias("comp")))
    split = (spot.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
             .select("sig"))
    open_lists = materialize(spot.join(split, "sig"), "open-lists")
    left = open_lists.select("sig", F.col("class").alias("a"), "n", F.col("room").alias("room_a"), F.col("comp").alias("of_a"))
    right = open_lists.select("sig", F.col("class").alias("b"), F.col("n").alias("m"), F.col("room").alias("room_b"), F.col("comp").alias("of_b"))
    crossing = (left.join(right, "sig")
                .where((F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b"))
                       & compatible(F.col("n"), F.col("m"), percent)
                       & linked(F.least("room_a", "room_b"), F.col("n"), F.col("m"), percent))
                .select("a", "b", "n", "m").distinct())
    more = check.links(materialize(check.likely(crossing), "crossing-pairs"))
    comps = components(links.unionByName(more))

    named = (holders.join(comps.withColumnRenamed("node", "class"), "class", "left")
             .select("class", "holder", F.coalesce("comp", "class").alias("comp")))
    smallest = named.groupBy("comp").agg(F.min("holder").alias("component_id"))
    ids = named.join(smallest, "comp").select("class", "component_id")
    return (rows.join(ids, "class", "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "class",
                    F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id")))
