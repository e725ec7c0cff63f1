"""Cells of vectors: a pruning table for exact search and an inverted index of product codes for approximate search.

Centres are fitted in mini-batches: each round moves them by another share of the rows, so that every row is used once
and a fit costs one pass. A table of n rows gets sqrt(n) cells (fewer if it is small); centres are what is broadcast, and MAX_CENTRE_BYTES
bounds them (beyond it cells grow instead). A large cell of a group is cut into blocks.

Exact search: a block keeps the least and greatest angle of its vectors to the cell's centre. By the triangle inequality no
vector of it can be nearer to a query than the difference of angles allows. The block nearest to each query is scored
first; its k-th score and the query's threshold then rule out whole blocks. Where they rule out too few, as a trial on some
queries shows, whole blocks of queries meet whole blocks of vectors.

Approximate search: vectors are stored as codes of their residuals (part by part the nearest entry of a codebook), in a
table partitioned by bands of cells. A query reads its nearest cells, and more of them until its own group has enough
vectors there; distances are sums of table entries; the nearest candidates are scored again with their vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialize
from .blocked import BLOCK_ROWS as PAIR_ROWS, _best, _cells, _matrix, _merge, _ranks, _unit, cosine_topk, score_block

#: Mini-batches of a fit: one for each BATCH_ROWS rows, within these limits.
FEWEST_ROUNDS, MOST_ROUNDS = 2, 8
BATCH_ROWS = 20_000
MAX_CENTRE_BYTES = 256 << 20
#: A small table has fewer cells than its square root, so that a cell is worth a task's call.
CELL_ROWS = 128
BLOCK_ROWS = 4096
QUERY_ROWS = 4096
#: Queries on which pruning is tried, and the share of open blocks up to which it is used.
TRIED_QUERIES = 1024
MOST_OPEN = 0.25
#: Angles and rounded scores may be off by this much.
SLACK = 4e-6
PART = 4
ENTRIES = 256
BANDS = 32
#: Queries whose distance tables are held at once.
TABLES = 128
#: Codes that a task holds at most, about; rows of a block of queries and of a block of vectors that are scored again.
TASK_CODES = 1 << 18
RERANK_ROWS = 1 << 15
#: Where all pairs of a large group are scored, a side has about so many blocks, of MOST_PAIR_ROWS rows at most.
PAIR_BLOCKS, MOST_PAIR_ROWS = 4, 1 << 14


# --------------------------------------------------------------------------- fitting
def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row."""
    out, half = np.empty(len(rows), np.int64), (centres * centres).sum(axis=1) / 2
    step = max(1, (1 << 22) // max(1, len(centres)))
    for at in range(0, len(rows), step):
        out[at:at + step] = np.argmin(half - rows[at:at + step] @ centres.T, axis=1)
    return out


def _sums(rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners that occur, their numbers of rows and the sums of these."""
    order = np.argsort(owner, kind="stable")
    found, begins = np.unique(owner[order], return_index=True)
    return found, np.diff([*begins, len(owner)]), np.add.reduceat(rows[order], begins, axis=0)


def _moved(batch: DataFrame, centres: np.ndarray, weights: np.ndarray, pieces) -> None:
    """One mini-batch: every centre goes towards the mean of its rows, by their share of all it has seen."""
    shared = batch.sparkSession.sparkContext.broadcast(centres)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for first, rows, own in pieces(b, shared.value):
                    found, n, total = _sums(rows, own)
                    yield pa.RecordBatch.from_arrays([pa.array(first + found), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))],
                                                     ["centre", "n", "total"])

    moved = (batch.mapInArrow(read, "centre long, n long, total array<double>").groupBy("centre")
             .agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")).toPandas())
    at, n = moved["centre"].to_numpy(np.int64), moved["n"].to_numpy(float)
    if len(at):
        weights[at] += n
        centres[at] += (np.stack(moved["total"].to_numpy()) - n[:, None] * centres[at]) / weights[at][:, None]


def _batches(rows: DataFrame) -> list[DataFrame]:
    rounds = max(FEWEST_ROUNDS, min(MOST_ROUNDS, rows.count() // BATCH_ROWS))
    return [rows.where(F.pmod(F.xxhash64(F.lit(7), "_nid"), F.lit(rounds)) == r).select("_nv") for r in range(rounds)]


def fit_cells(rows: DataFrame, cells: int | None = None) -> np.ndarray:
    """Centres (cells, d) of unit vectors; rows: _nid, _nv."""
    first = rows.select("_nv").first()
    if first is None:
        return np.zeros((0, 1))
    if cells is None:
        n = rows.count()
        cells = min(math.ceil(math.sqrt(n)), max(1, n // CELL_ROWS), max(1, MAX_CENTRE_BYTES // (8 * len(first["_nv"]))))
    begin = rows.orderBy(F.xxhash64("_nid"), "_nid").limit(cells).select("_nv").collect()
    centres = _unit(np.array([r["_nv"] for r in begin], np.float64))
    weights = np.ones(len(centres))

    def pieces(batch: pa.RecordBatch, now: np.ndarray):
        m = _unit(_matrix(pa.Table.from_batches([batch]), "_nv"))
        yield 0, m, _nearest(m, now)

    for batch in _batches(rows):
        _moved(batch, centres, weights, pieces)
    return centres


def _parts(m: np.ndarray) -> np.ndarray:
    """(rows, parts, PART), filled up with zeros."""
    short = -m.shape[1] % PART
    return np.pad(m, ((0, 0), (0, short))).reshape(len(m), -1, PART)


def _code(parts: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.stack([_nearest(parts[:, p], books[p]) for p in range(parts.shape[1])], axis=1).astype(np.uint8)


def fit_books(rows: DataFrame, centres: np.ndarray, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (parts, entries, PART) of the residuals; rows: _nid, _nv."""
    begin = rows.orderBy(F.xxhash64(F.lit(1), "_nid"), "_nid").limit(entries).select("_nv").collect()
    first = _unit(np.array([r["_nv"] for r in begin], np.float64))
    books = _parts(first - centres[_nearest(first, centres)]).transpose(1, 0, 2).copy()
    parts, entries, _ = books.shape
    weights, flat = np.ones(parts * entries), books.reshape(-1, PART)

    def pieces(batch: pa.RecordBatch, now: np.ndarray):
        m = _unit(_matrix(pa.Table.from_batches([batch]), "_nv"))
        cut = _parts(m - centres[_nearest(m, centres)])
        codes = _code(cut, now.reshape(parts, entries, PART))
        for p in range(parts):
            yield p * entries, cut[:, p], codes[:, p].astype(np.int64)

    for batch in _batches(rows):
        _moved(batch, flat, weights, pieces)
    return flat.reshape(parts, entries, PART)


# --------------------------------------------------------------------------- shared steps
def _ddl(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def _sides(queries, nodes, group, query_id, node_id, query_vec, node_vec, k):
    fresh = [F.col(g).alias(g) for g in group]        # both sides may come from one table
    q = queries.select(*fresh, F.col(query_id).alias("_qid"), F.col(query_vec).cast("array<double>").alias("_qv"), F.col(k).alias("_k"))
    n = nodes.select(*fresh, F.col(node_id).alias("_nid"), F.col(node_vec).cast("array<double>").alias("_nv"))
    return q, n


def _in_blocks(placed: DataFrame, group: list[str], block_rows: int) -> DataFrame:
    """``placed`` with _sub, the block inside its cell; only cells above ``block_rows`` of a group have several."""
    large = (placed.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
             .select(*group, "_cell", F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_subs")))
    return (placed.join(large, [*group, "_cell"], "left")
            .withColumn("_sub", F.pmod(F.xxhash64("_nid"), F.coalesce("_subs", F.lit(1))).cast("int")).drop("_subs"))


def _scored(pairs: DataFrame, q: DataFrame, stored: DataFrame, group: list[str], task) -> DataFrame:
    """``task`` over each block and those queries that ``pairs`` (group, _qid, _cell, _sub) sends to it. A block is copied only
    as often as its own queries fill a block of QUERY_ROWS."""
    where = [*group, "_cell", "_sub"]
    asks = pairs.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("_qn"))
    asked = (pairs.join(asks, where).withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.col("_qn")).cast("int")).drop("_qn")
             .join(q, [*group, "_qid"]))
    sent = stored.join(asks, where).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_qn") - 1))).drop("_qn")
    ddl = _ddl(q, [*group, "_qid", "_k"]) + f"_nid {stored.schema['_nid'].dataType.simpleString()}, score double"
    return asked.groupBy(*where, "_qb").cogroup(sent.groupBy(*where, "_qb")).applyInArrow(task, ddl)


# --------------------------------------------------------------------------- exact search
def place(rows: DataFrame, centres: np.ndarray, group: list[str]) -> DataFrame:
    """rows with _cell (-1: a zero vector, which has no direction) and _angle to the centre."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, _unit(centres)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(pa.Table.from_batches([b]), "_nv")
            u, (near, directions) = _unit(m), shared.value
            cell = _nearest(u, near)
            angle = np.arccos(np.clip((u * directions[cell]).sum(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(m.any(axis=1), cell, -1).astype(np.int32)), pa.array(angle)],
                                             [*b.schema.names, "_cell", "_angle"])

    return rows.mapInArrow(read, _ddl(rows, rows.columns) + "_cell int, _angle double")


def _whole_if_small(placed: DataFrame, group: list[str], block_rows: int) -> DataFrame:
    """Groups that fit in a block stay one, in the cell without a direction."""
    if not group:
        return placed
    large = (placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
             .select(*group, F.lit(True).alias("_large")))
    return (placed.join(large, group, "left")
            .withColumn("_cell", F.when(F.col("_large"), F.col("_cell")).otherwise(-1)).drop("_large"))


def block_table(placed: DataFrame, group: list[str]) -> DataFrame:
    """The pruning table: rows and range of angles of each block."""
    return placed.groupBy(*group, "_cell", "_sub").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_angle").alias("_low"), F.max("_angle").alias("_high"))


def _bounds(q: DataFrame, blocks: DataFrame, group: list[str], centres: np.ndarray, floor: str, nearest: bool) -> DataFrame:
    """(group, _qid, _cell, _sub): the block of the largest bound of each query, or all blocks with a bound of at least the
    query's ``floor``. Queries meet the pruning table of their group, not its vectors."""
    shared = q.sparkSession.sparkContext.broadcast(_unit(centres))
    spread = q.select(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("n")).first()["n"] or 1
    dealt = q.withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.lit(spread)).cast("int"))
    asking = dealt.select(*[F.col(c).alias(c) for c in [*group, "_qb"]]).distinct()
    tables = blocks.join(asking, group) if group else blocks.withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, cols = np.empty(0, np.int64), np.empty(0, np.int64)
        if left.num_rows and right.num_rows:
            m = _matrix(left, "_qv")
            cell, low, high = (right.column(c).to_numpy() for c in ("_cell", "_low", "_high"))
            angle = np.arccos(np.clip(_unit(m) @ shared.value.T, -1, 1))[:, np.maximum(cell, 0)]
            bound = np.cos(np.maximum(np.maximum(angle - high, low - angle), 0))
            bound[:, cell < 0] = 1
            bound[~m.any(axis=1)] = 1
            if nearest:
                rows, cols = np.arange(len(m)), np.argmax(bound - angle * 1e-9, axis=1)
            else:
                rows, cols = np.nonzero(bound + SLACK >= left.column(floor).to_numpy()[:, None])
        out = left.select([*group, "_qid"]).take(pa.array(rows))
        for name in ("_cell", "_sub"):
            out = out.append_column(name, right.column(name).take(pa.array(cols)).combine_chunks())
        return out

    keys = [*group, "_qb"]
    return dealt.groupBy(*keys).cogroup(tables.groupBy(*keys)).applyInArrow(task, _ddl(q, [*group, "_qid"]) + "_cell int, _sub int")


def _every_pair(q: DataFrame, blocks: DataFrame, group: list[str]) -> DataFrame:
    """(group, _qid, _cell, _sub) of every query and block of its group."""
    asked = q.select(*[F.col(c).alias(c) for c in group], "_qid")
    met = blocks.select(*group, "_cell", "_sub")
    return asked.join(met, group) if group else asked.crossJoin(met)


def _rules_out(bounded: DataFrame, blocks: DataFrame, group: list[str], centres: np.ndarray) -> bool:
    """Whether the bounds leave at most MOST_OPEN of the blocks to read, tried on about TRIED_QUERIES queries. A block that a
    query reads on its own costs a copy of its vector; vectors equally far from each other are scored as whole blocks of
    queries instead. Either way gives the same rows."""
    share = max(1, bounded.count() // TRIED_QUERIES)
    some = materialize(bounded.where(F.pmod(F.xxhash64(F.lit(3), "_qid"), F.lit(share)) == 0), "tried-queries")
    read = _bounds(some, blocks, group, centres, "_floor", False).count()
    return read <= MOST_OPEN * _every_pair(some, blocks, group).count()


def pruned_cosine_topk(queries: DataFrame, nodes: DataFrame, group: list[str], query_id: str, node_id: str, query_vec: str,
                       node_vec: str, k: str, digits: int, max_k: int, threshold: str | None = None, cells: int | None = None,
                       block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(matches as of cosine_topk, pairs of query and block that were scored). ``threshold`` is a column of queries below
    which scores don't matter; the same rows as scoring everything, cut at the threshold."""
    q, n = _sides(queries, nodes, group, query_id, node_id, query_vec, node_vec, k)
    asked = queries.select(F.col(query_id).alias("_qid"), *group, (F.col(threshold) if threshold else F.lit(-2.0)).alias("_least"))
    n = materialize(n, "node-vectors")
    centres = fit_cells(n.select("_nid", "_nv"), cells)
    placed = materialize(place(n, centres, group), "angles")
    placed = materialize(_in_blocks(_whole_if_small(placed, group, block_rows), group, block_rows), "placed")
    blocks = materialize(block_table(placed, group), "block-table")
    q = materialize(q.join(asked, [*group, "_qid"]), "query-vectors")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        return score_block(left, right, group, digits)

    stored = placed.select(*group, "_cell", "_sub", "_nid", "_nv")
    nearest = materialize(_bounds(q, blocks, group, centres, "_least", True), "nearest-blocks")
    first = materialize(_scored(nearest, q, stored, group, task), "first-scores")
    by_score = Window.partitionBy(*group, "_qid").orderBy(F.col("score").desc())
    reached = (first.withColumn("_rn", F.row_number().over(by_score)).where(F.col("_rn") <= max_k).where(F.col("_rn") == F.col("_k"))
               .select(*group, "_qid", F.col("score").alias("_reached")))
    bounded = q.join(reached, [*group, "_qid"], "left").withColumn("_floor", F.greatest("_least", F.coalesce("_reached", F.lit(-2.0))))
    if not _rules_out(bounded, blocks, group, centres):
        every = _every_pair(q, blocks, group)
        largest = blocks.groupBy(*group).agg(F.sum("_rows").alias("_n")).agg(F.max("_n")).first()[0] or 0
        rows = min(MOST_PAIR_ROWS, max(PAIR_ROWS, math.ceil(largest / PAIR_BLOCKS)))
        return cosine_topk(queries, nodes, group, query_id, node_id, query_vec, node_vec, k, digits, rows, max_k), every
    others = _bounds(bounded, blocks, group, centres, "_floor", False)
    others = materialize(others.join(nearest, [*group, "_qid", "_cell", "_sub"], "left_anti"), "open-blocks")
    second = _scored(others, q, stored, group, task)
    found = _merge(first.unionByName(second), group, query_id, node_id, "similarity", max_k)
    return found, nearest.unionByName(others)


# --------------------------------------------------------------------------- approximate search
@dataclass
class CodeIndex:
    """Codes by cell: ``codes`` (group, _cell, _sub, _nid, _code), ``counts`` (group, _cell, _n, _subs)."""
    group: list[str]
    centres: np.ndarray
    books: np.ndarray
    codes: DataFrame
    counts: DataFrame

    def save(self, path: str) -> None:
        """As tables below ``path``; codes are partitioned by bands of cells and sorted by cell."""
        spark = self.codes.sparkSession
        band = F.floor(F.col("_cell") * BANDS / F.lit(max(1, len(self.centres)))).cast("int")
        (self.codes.withColumn("_band", band).repartitionByRange("_band", "_cell").sortWithinPartitions("_band", "_cell", "_sub")
         .write.partitionBy("_band").parquet(f"{path}/codes"))
        self.counts.write.parquet(f"{path}/counts")
        for name, values in (("centres", self.centres), ("books", self.books.reshape(-1, PART))):
            rows = pa.table({"at": np.arange(len(values)), "v": pa.array(list(values), pa.list_(pa.float64()))})
            spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, group: list[str]) -> CodeIndex:
        def matrix(name: str) -> np.ndarray:
            return np.array([r["v"] for r in spark.read.parquet(f"{path}/{name}").orderBy("at").collect()], np.float64)
        centres, books = matrix("centres"), matrix("books")
        parts = -(-centres.shape[1] // PART)
        return CodeIndex(group, centres, books.reshape(parts, -1, PART), spark.read.parquet(f"{path}/codes").drop("_band"),
                         spark.read.parquet(f"{path}/counts"))


def build_codes(nodes: DataFrame, group: list[str], node_id: str, node_vec: str, cells: int | None = None,
                block_rows: int = BLOCK_ROWS) -> CodeIndex:
    rows = materialize(nodes.select(*group, F.col(node_id).alias("_nid"), F.col(node_vec).cast("array<double>").alias("_nv")), "node-vectors")
    centres = fit_cells(rows.select("_nid", "_nv"), cells)
    books = fit_books(rows.select("_nid", "_nv"), centres) if len(centres) else np.zeros((0, 0, PART))
    shared = rows.sparkSession.sparkContext.broadcast((centres, books))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, (near, entries) = _unit(_matrix(pa.Table.from_batches([b]), "_nv")), shared.value
                cell = _nearest(u, near)
                codes = _code(_parts(u - near[cell]), entries)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(g) for g in group], b.column("_nid"), pa.array(cell.astype(np.int32)),
                     pa.array([c.tobytes() for c in codes], pa.binary())], [*group, "_nid", "_cell", "_code"])

    coded = materialize(rows.mapInArrow(read, _ddl(rows, [*group, "_nid"]) + "_cell int, _code binary"), "cell-codes")
    codes = materialize(_in_blocks(coded, group, block_rows), "codes")
    counts = codes.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"), (F.max("_sub") + 1).alias("_subs"))
    return CodeIndex(group, centres, books, codes, materialize(counts, "cell-counts"))


def _blocked(q: DataFrame, group: list[str]) -> DataFrame:
    """q with _qb, the block of a query in its group; rows of one ``_qid`` stay together."""
    count = F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("_qn")
    return _met(q, q.groupBy(*group).agg(count), group).withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.col("_qn")).cast("int")).drop("_qn")


def _met(rows: DataFrame, table: DataFrame, group: list[str]) -> DataFrame:
    fresh = table.select(*[F.col(c).alias(c) for c in table.columns])         # both sides may come from one table
    return rows.join(fresh, group) if group else rows.crossJoin(fresh)


def _chosen(blocked: DataFrame, index: CodeIndex, probes: int, wanted: int) -> DataFrame:
    """The rows of ``_blocked`` with _cells, the nearest cells of each query in which its group has vectors, ``probes`` at least
    and as many as hold ``wanted`` vectors of the group (or all of them). Queries meet the counts of their group's cells."""
    group, shared = index.group, blocked.sparkSession.sparkContext.broadcast(index.centres)
    keys = [*group, "_qb"]
    told = _met(index.counts.select(*group, "_cell", "_n"), blocked.select(*keys).distinct(), group)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            left = left.slice(0, 0)
        centres, found, sizes = shared.value, [np.empty(0, np.int32)], []
        order = np.argsort(right.column("_cell").to_numpy(), kind="stable")
        cell, held = right.column("_cell").to_numpy()[order], right.column("_n").to_numpy()[order]
        queries = _unit(_matrix(left, "_qv")) if left.num_rows else np.empty((0, 1))
        half = (centres * centres).sum(axis=1) / 2
        for at in range(0, len(queries), TABLES):
            near = half - queries[at:at + TABLES] @ centres.T
            last = np.partition(near, min(probes, len(centres)) - 1, axis=1)[:, min(probes, len(centres)) - 1]
            own = near[:, cell]
            order = np.argsort(own, axis=1, kind="stable")
            own, n = np.take_along_axis(own, order, axis=1), held[order]
            read = (np.cumsum(n, axis=1) - n < wanted) | (own <= last[:, None])
            found.append(cell[order][read].astype(np.int32))
            sizes += read.sum(axis=1).tolist()
        ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
        return left.append_column("_cells", pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found))))

    return (blocked.groupBy(*keys).cogroup(told.groupBy(*keys))
            .applyInArrow(task, _ddl(blocked, blocked.columns) + "_cells array<int>"))


def _probed(q: DataFrame, index: CodeIndex, probes: int, wanted: int) -> DataFrame:
    """(group, _qid, _cell, _sub): the blocks of codes that each query reads."""
    cells = _chosen(_blocked(q, index.group), index, probes, wanted).select(*index.group, "_qid", F.explode("_cells").alias("_cell"))
    return cells.join(index.counts, [*index.group, "_cell"]).select(
        *index.group, "_qid", "_cell", F.explode(F.sequence(F.lit(0), F.col("_subs") - 1)).alias("_sub"))


def _own_rows(cells: np.ndarray, found: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``cells`` in a table sorted by cell; the cells that it has, and their sizes."""
    at = np.minimum(np.searchsorted(found, cells), len(found) - 1)
    at = at[found[at] == cells]
    n = sizes[at]
    return np.repeat(begins[at] - (np.cumsum(n) - n), n) + np.arange(n.sum()), found[at], n


def code_candidates(q: DataFrame, index: CodeIndex, wanted: int, probes: int, rerank: int) -> DataFrame:
    """(group, _qid, _nids): the ``rerank`` vectors nearest to each query by their codes; q: group, _qid, _qv, _k.

    A block of queries meets all codes of its group in one task, or those of large groups in several of TASK_CODES codes, and only
    the best of each query leave it. Codes are a few bytes a vector, so that they can be copied per block of queries; vectors and
    pairs of a query and a cell are not. The distance to a code is that to its cell's centre, a number of the code and a sum
    of entries of one table of the query."""
    group = index.group
    shared = q.sparkSession.sparkContext.broadcast((index.centres, index.books))
    blocked = _blocked(q, group)
    parts = materialize(index.counts.groupBy(*group).agg(F.ceil(F.sum("_n") / F.lit(TASK_CODES)).cast("int").alias("_parts")), "code-parts")
    several = (parts.agg(F.max("_parts")).first()[0] or 1) > 1
    read = _met(_chosen(blocked, index, probes, wanted), parts, group).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    codes = _met(index.codes.select(*group, "_cell", "_sub", "_nid", "_code"), parts, group).withColumn(
        "_part", F.pmod(F.xxhash64("_cell", "_sub"), F.col("_parts")).cast("int")).drop("_parts", "_sub")
    sent = _met(codes, blocked.select(*group, "_qb").distinct(), group)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        nids, ids = [np.empty(0, np.int64)], right.column("_nid").combine_chunks()
        scores, first = [np.empty(0)], []
        if left.num_rows and right.num_rows:
            centres, books = shared.value
            by_cell = np.argsort(right.column("_cell").to_numpy(), kind="stable")
            cell, ids = right.column("_cell").to_numpy()[by_cell], ids.take(pa.array(by_cell))
            found, begins, sizes = np.unique(cell, return_index=True, return_counts=True)
            codes = np.frombuffer(b"".join(right.column("_code").to_pylist()), np.uint8).reshape(len(ids), -1)[by_cell]
            entry = codes + np.arange(codes.shape[1], dtype=np.int32) * books.shape[1]
            flat, of_code = books.reshape(-1, PART), np.empty(len(ids))
            for at in range(0, len(ids), QUERY_ROWS):
                entries = flat[entry[at:at + QUERY_ROWS]]
                of_code[at:at + QUERY_ROWS] = (entries * (entries + 2 * _parts(centres[cell[at:at + QUERY_ROWS]]))).sum(axis=(1, 2))
            ranks, queries = _ranks(ids.to_numpy(zero_copy_only=False)), _unit(_matrix(left, "_qv"))
            asked = left.column("_cells").combine_chunks()
            cells, ends = asked.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(asked).to_pylist()])
            number = left.column("_qid").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            _, begun, rows = np.unique(number, return_index=True, return_counts=True)
            same = np.split(np.argsort(number, kind="stable"), np.cumsum(rows)[:-1])           # rows of one id count together
            for at in range(0, len(same), TABLES):
                some = np.concatenate(same[at:at + TABLES])
                tables = dict(zip(some.tolist(), -2 * np.einsum("tpd,ped->tpe", _parts(queries[some]), books, optimize=True)))
                for own in same[at:at + TABLES]:
                    where, near, n = _own_rows(np.concatenate([cells[ends[i]:ends[i + 1]] for i in own]), found, begins, sizes)
                    distance = np.concatenate([tables[i].ravel()[entry[where]].sum(axis=1) + of_code[where]
                                               + np.repeat(((queries[i] - centres[near]) ** 2).sum(axis=1), n) for i in own.tolist()])
                    where = np.tile(where, len(own))
                    best = _best(-distance, rerank, ranks[where], False)
                    nids.append(where[best])
                    scores.append(-distance[best])
            first = begun
        ends = pa.array(np.cumsum([0, *[len(x) for x in nids[1:]]]), pa.int32())
        rows = left.select([*group, "_qid"]).take(pa.array(np.asarray(first, np.int64)))
        return (rows.append_column("_nids", pa.ListArray.from_arrays(ends, ids.take(pa.array(np.concatenate(nids)))))
                .append_column("_scores", pa.ListArray.from_arrays(ends, pa.array(np.concatenate(scores)))))

    where = [*group, "_qb", "_part"]
    kind = index.codes.schema["_nid"].dataType.simpleString()
    near = read.groupBy(*where).cogroup(sent.groupBy(*where)).applyInArrow(
        task, _ddl(q, [*group, "_qid"]) + f"_nids array<{kind}>, _scores array<double>")
    if several:
        nearest = F.transform(F.arrays_zip("_scores", "_nids"), lambda x: F.struct((-x["_scores"]).alias("at"), x["_nids"].alias("nid")))
        near = near.groupBy(*group, "_qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list(nearest))), 1, rerank).alias("_near"))
        return near.select(*group, "_qid", F.transform("_near", lambda x: x["nid"]).alias("_nids"))
    return near.drop("_scores")


def rescored(q: DataFrame, near: DataFrame, vectors: DataFrame, group: list[str], digits: int) -> DataFrame:
    """(group, _qid, _nid, similarity): the best _k of each query's candidates (``near``: group, _qid, _nids) by rounded cosine with
    their vectors (group, _nid, _nv); null for a zero vector. Blocks of queries meet blocks of vectors, so that a vector is copied
    once per block and not for each query that has found it."""
    asked = q.join(near.withColumn("_nids", F.filter("_nids", lambda x: x.isNotNull())), [*group, "_qid"])
    qs, ns = _cells(group, asked, vectors.where(F.col("_nid").isNotNull()), RERANK_ROWS)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        owner, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        ids, lists = right.column("_nid").combine_chunks(), left.column("_nids").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and len(flat):
            names, queries, nodes = ids.to_numpy(zero_copy_only=False), _matrix(left, "_qv"), _matrix(right, "_nv")
            order = np.argsort(names, kind="stable")
            low, high = (np.searchsorted(names[order], flat, side) for side in ("left", "right"))
            n = high - low
            owner = np.repeat(np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), n)
            at = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            none, units, others = [~m.any(axis=1) for m in (queries, nodes)], _unit(queries), _unit(nodes)
            score = np.concatenate([np.empty(0), *[(units[owner[i:i + QUERY_ROWS]] * others[at[i:i + QUERY_ROWS]]).sum(axis=1)
                                                   for i in range(0, len(owner), QUERY_ROWS)]])
            score = np.where(none[0][owner] | none[1][at], -np.inf, np.round(score, digits) + 0.0)
            best = np.lexsort((_ranks(names)[at], -score, owner))
            place = np.arange(len(best)) - np.searchsorted(owner[best], owner[best])
            best = best[place < left.column("_k").to_numpy()[owner[best]]]
            owner, at, score = owner[best], at[best], score[best]
        return (left.select([*group, "_qid"]).take(pa.array(owner)).append_column("_nid", ids.take(pa.array(at)))
                .append_column("similarity", pa.array(score, mask=np.isneginf(score))))

    where = [*group, "_qb", "_nb"]
    return qs.groupBy(*where).cogroup(ns.groupBy(*where)).applyInArrow(
        task, _ddl(q, [*group, "_qid"]) + f"_nid {vectors.schema['_nid'].dataType.simpleString()}, similarity double")
