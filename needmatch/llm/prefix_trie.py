"""Prefix trie of conversations by a skeleton of splitter paths.

A conversation is a path: 16 bytes a turn, the digest of role and text. Paths are cut into shards by splitters from a
sample, each the shortest separator of two neighbouring samples, or a whole path with a conversation id where both are
equal, so that copies are dealt to several shards as well. Rows are sorted by path and id inside a shard. A node whose
members lie in two shards is a prefix of a splitter between them. So the trie of the splitter paths, the skeleton, is
broadcast, and a streaming pass over each sorted shard finishes all other nodes, with one open frame a turn of the current
path. Of skeleton nodes a shard only sends partial aggregates, one row a shard and node, which a reduction combines; what
lies below a skeleton node is then added up along the skeleton.

A node's ids of conversations that end there come in ascending order, because equal paths are sorted by id, and shorter
paths stand before longer ones. A skeleton node's ids may lie in many shards: they are sent as chunks of joined text and
hashed chunk by chunk in order. SHA-256 of one message is sequential by nature, so that one stream, of a few bytes a
conversation, is all that a single task does for a node.

Texts never move: a turn is a digest and a count of words. What is in memory at once is a conversation's turns (about 30
bytes each), the frames of one path and the finished children of open nodes inside a shard. The skeleton has at most
MAX_SKELETON nodes; splitters that would take it beyond are left out, which makes shards larger but no result different.

Defined results: null roles and texts are empty; turns of one conversation are ordered by number, nulls first, those with
equal numbers by digest; repeated rows are repeated turns; rows without a conversation id are left out; a conversation
without turns is a member of the root; an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .words import SPACE

DIGEST = 16
#: Turns and conversations of a shard, about.
SHARD_TURNS = 200_000
MAX_SHARDS = 20_000
#: Sampled conversations a shard, turns of each and bytes of all (expected).
SAMPLES = 8
SAMPLE_TURNS = 1024
MAX_SAMPLE_BYTES = 64 << 20
MAX_SKELETON = 500_000
#: Rows of an output batch; ids of a chunk.
ROWS = 20_000
CHUNK_IDS = 1 << 16
#: Every conversation takes its first turns from the one whose id is the next smaller multiple of this.
FAMILY = 20
HEADS = 4

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SENT = "kind int, node int, words long, first long, chunk binary, " + NODE
#: Kinds of rows that shards send.
FINISHED, PARTIAL, ENDS = range(3)


def turn_lists(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): per conversation its ordered turns as structs of number, digest and words."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)), 1, DIGEST)
    words = F.regexp_count(text_, F.lit(f"[^{SPACE}]+")).cast("int")
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), digest.alias("digest"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_family_heads(lists: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The first h turns of each conversation c replaced by those of conversation c - c % family; h = crc32(c) % heads."""
    shared = lists.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    own = F.slice("turns", h + 1, F.size("turns"))
    return (lists.join(shared, F.col("conv_id") - F.col("conv_id") % family == F.col("base"), "left")
            .select("conv_id", F.concat(first, own).alias("turns")))


class Splitters:
    """Where shards begin: (path,) before all its members, or (path, id) inside them; sorted."""

    def __init__(self, keys: list[tuple]):
        self.keys = sorted(keys)

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.keys, (path, conv))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns at the start of both paths."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle * DIGEST] == b[:middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def separators(sample: list[tuple[bytes, int, int]], shards: int) -> list[tuple]:
    """At most shards - 1 splitters that cut the sampled (path, id, weight) into parts of about equal weight."""
    sample = sorted(sample)
    share, at, out = sum(w for _, _, w in sample) / shards, 0.0, {}
    for (a, _, weight), (b, conv, _) in zip(sample, sample[1:], strict=False):
        before, at = at, at + weight
        if int(before / share) < int(at / share):
            key = (b, conv) if a == b else (b[:(common_turns(a, b) + 1) * DIGEST],)
            out[key] = None
    return list(out)


class Skeleton:
    """Trie of the splitter paths; node 0 is the root, and parents have smaller numbers than their children."""

    def __init__(self):
        self.children: list[dict[bytes, int]] = [{}]
        self.parents, self.depths = [-1], [0]

    def add(self, path: bytes, most: int) -> bool:
        """Adds the path unless the trie would get more than ``most`` nodes."""
        node, at = 0, 0
        while at < len(path) and (child := self.children[node].get(path[at:at + DIGEST])) is not None:
            node, at = child, at + DIGEST
        if len(self.parents) + (len(path) - at) // DIGEST > most:
            return False
        for i in range(at, len(path), DIGEST):
            self.children[node][path[i:i + DIGEST]] = child = len(self.parents)
            self.parents.append(node)
            self.depths.append(self.depths[node] + 1)
            self.children.append({})
            node = child
        return True


def skeleton(keys: list[tuple], most: int) -> tuple[Splitters, Skeleton]:
    trie = Skeleton()
    kept = [k for k in sorted(keys, key=lambda k: len(k[0])) if trie.add(k[0], most)]
    return Splitters(kept), trie


class Frame:
    """An open node."""
    __slots__ = ("node", "words", "least", "convs", "children", "leaves", "saved", "ends", "ids", "below")

    def __init__(self, node: int | None, words: int):
        self.node, self.words = node, words     # number in the skeleton, or None
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.ids = None, []          # running hash of a local node, pending ids of a skeleton node
        self.below: list[tuple] = []            # finished children, which wait for this node's smallest member


class Shard:
    """Streaming pass over the rows of one shard in order of path and id; ``rows`` are ready to be sent."""

    def __init__(self, trie: Skeleton, rows: list[tuple]):
        self.trie, self.rows = trie, rows
        self.path, self.open = b"", [Frame(0, 0)]

    def add(self, path: bytes, conv: int, words: list[int]) -> None:
        depth = common_turns(self.path, path)
        while len(self.open) > depth + 1:
            self.close()
        for d in range(depth, len(words)):
            above = self.open[-1].node
            node = None if above is None else self.trie.children[above].get(path[d * DIGEST:(d + 1) * DIGEST])
            self.open.append(Frame(node, words[d]))
        self.path, top = path, self.open[-1]
        top.convs += 1
        top.least = conv if top.least is None else min(top.least, conv)
        if top.node is not None:
            top.ids.append(conv)
            if len(top.ids) >= CHUNK_IDS:
                self.send_ids(top)
        elif top.ends is None:
            top.ends = hashlib.sha256(str(conv).encode())
        else:
            top.ends.update(b",%d" % conv)

    def send_ids(self, top: Frame) -> None:
        self.rows.append((ENDS, top.node, None, top.ids[0], ",".join(map(str, top.ids)).encode(), *[None] * 8))
        top.ids = []

    def close(self) -> None:
        depth, done = len(self.open) - 1, self.open.pop()
        above = self.open[-1] if self.open else None
        if above is not None:
            above.convs += done.convs
            above.least = done.least if above.least is None else min(above.least, done.least)
        if done.node is not None:
            if done.ids:
                self.send_ids(done)
            self.rows.append((PARTIAL, done.node, done.words, None, None, done.least, depth, None, done.convs, done.children,
                              done.leaves, done.saved, None))
            return
        leaves = done.leaves if done.children else 1
        saved = done.saved + (done.convs - 1) * done.words
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        self.rows += [(FINISHED, None, None, None, None, least, depth + 1, done.least, *rest) for least, *rest in done.below]
        ends = done.ends or hashlib.sha256()
        own = (done.least, done.convs, done.children, leaves, saved, ends.hexdigest())
        if above.node is None:
            above.below.append(own)
        else:       # the smallest member of a skeleton node is known after the reduction
            self.rows.append((FINISHED, above.node, None, None, None, own[0], depth, None, *own[1:]))

    def end(self) -> None:
        while self.open:
            self.close()


def sent_by_shards(dealt: DataFrame, trie: Skeleton) -> DataFrame:
    """Rows (SENT) of all shards; ``dealt`` has whole shards in its partitions, sorted by shard, path and conv_id."""
    shared = dealt.sparkSession.sparkContext.broadcast(trie)
    kinds = [("kind", pa.int32()), ("node", pa.int32()), ("words", pa.int64()), ("first", pa.int64()), ("chunk", pa.binary()),
             *[(name, pa.int64()) for name in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
             ("ends_sha256", pa.string())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          [name for name, _ in kinds])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        number, current = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words")]
            for shard, path, conv, words in zip(*columns, strict=True):
                if shard != number:
                    if current is not None:
                        current.end()
                    number, current = shard, Shard(shared.value, rows)
                current.add(path, conv, words)
                if len(rows) >= ROWS or rows and rows[-1][0] == ENDS:
                    yield batch_of(rows)
                    rows.clear()
        if current is not None:
            current.end()
        for begin in range(0, len(rows), ROWS):
            yield batch_of(rows[begin:begin + ROWS])

    return dealt.mapInArrow(read, SENT)


def rolled_up(trie: Skeleton, partials: dict[int, tuple]) -> list[tuple]:
    """(node, NODE without the hash) of skeleton nodes; partials: node -> (least, convs, children, leaves, saved, words)."""
    totals = {n: [0, 0, 0] for n in partials}      # children, leaves, saved tokens of the subtree
    for n in sorted(partials, reverse=True):
        _, convs, children, leaves, saved, words = partials[n]
        own = totals[n]
        own[0] += children
        own[1] = own[1] + leaves if own[0] else 1
        own[2] += saved + (convs - 1) * words
        if n:
            above = totals[trie.parents[n]]
            above[0] += 1
            above[1] += own[1]
            above[2] += own[2]
    return [(n, p[0], trie.depths[n], partials[trie.parents[n]][0] if n else None, p[1], *totals[n]) for n, p in partials.items()]


def hashed_ends(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256) from chunks of joined ids, in order."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done = []
            for n, chunk in zip(batch.column("node").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                if n != node:
                    if node is not None:
                        done.append((node, running.hexdigest()))
                    node, running = n, hashlib.sha256(chunk)
                else:
                    running.update(b"," + chunk)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int32()), pa.array([h for _, h in done])], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])

    return (chunks.select("node", "first", "chunk").repartition("node").sortWithinPartitions("node", "first")
            .mapInArrow(read, "node int, ends_sha256 string"))


def prefix_trie(lists: DataFrame, shards: int | None = None, max_skeleton: int = MAX_SKELETON) -> DataFrame:
    """One row (NODE) for every distinct prefix of the conversations' turns; ``lists`` as turn_lists gives them."""
    spark = lists.sparkSession
    hexed = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    paths = materialize(lists.select("conv_id", F.unhex(hexed).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")), "paths")
    size = paths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("turns"),
                     F.coalesce(F.sum(F.least(F.length("path"), F.lit(SAMPLE_TURNS * DIGEST))), F.lit(0)).alias("bytes")).first()
    if not size["n"]:
        return spark.createDataFrame([], NODE)
    if shards is None:
        wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["n"] + size["turns"]) // SHARD_TURNS))
        shards = min(wanted, MAX_SHARDS)
    sampled = int(min(SAMPLES * shards, max(shards, MAX_SAMPLE_BYTES // (size["bytes"] / size["n"] + 64))))
    sample = (paths.select(F.substring("path", 1, SAMPLE_TURNS * DIGEST).alias("path"), "conv_id", (F.size("words") + 1).alias("weight"))
              .orderBy(F.xxhash64("conv_id"), "conv_id").limit(sampled).collect())
    cuts, trie = skeleton(separators([(bytes(r["path"]), r["conv_id"], r["weight"]) for r in sample], shards), max_skeleton)
    shared = spark.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [shared.value.shard(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    dealt = (paths.mapInArrow(deal, "shard int, conv_id long, path binary, words array<int>")
             .repartitionById(shards, "shard").sortWithinPartitions("shard", "path", "conv_id"))
    sent = materialize(sent_by_shards(dealt, trie), "trie")

    # as many rows as the skeleton has nodes
    partials = (sent.where(F.col("kind") == PARTIAL).groupBy("node")
                .agg(F.min("conv_id").alias("least"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                     F.max("words").alias("words")).collect())
    rows = rolled_up(trie, {r["node"]: tuple(r)[1:] for r in partials})
    upper = spark.createDataFrame(rows, "node int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = hashed_ends(sent.where(F.col("kind") == ENDS))
    nothing = F.lit(hashlib.sha256().hexdigest())
    skeleton_nodes = upper.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).drop("node")

    names = [f.split()[0] for f in NODE.split(", ")]
    parents = upper.select("node", F.col("conv_id").alias("_parent"))
    finished = (sent.where(F.col("kind") == FINISHED).join(F.broadcast(parents), "node", "left")
                .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent")))
    return finished.select(*names).unionByName(skeleton_nodes.select(*names))
