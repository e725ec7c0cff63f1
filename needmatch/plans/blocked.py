"""Exact top-k scoring of two tables without emitting all pairs.

Both sides are hashed into blocks of bounded size per group; a task multiplies one query block
with one node block and keeps only each query's best k. The pair matrix never leaves the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

BLOCK_ROWS = 4096
#: Queries of a block that are scored at once, which bounds the scores held.
STRIP_ROWS = 256


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    col = table.column(name).combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _cells(group: list[str], q: DataFrame, n: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers _qb and _nb: rows of one ``_qid`` / ``_nid`` stay together, a block
    holds about ``block_rows`` of them, and each side is copied once per block of the other."""
    def size(df: DataFrame, ident: str) -> DataFrame:
        return df.select(*group, ident).distinct().groupBy(*group).agg(
            F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_n"))
    if group:
        sizes = (size(q, "_qid").withColumnRenamed("_n", "_qn")
                 .join(size(n, "_nid").withColumnRenamed("_n", "_nn"), group))
        q, n = q.join(sizes, group), n.join(sizes, group)
    else:                                                     # one group: its two sizes are two numbers
        counts = {name: max(1, size(df, ident).first()["_n"]) for name, df, ident in (("_qn", q, "_qid"), ("_nn", n, "_nid"))}
        q, n = (df.withColumns({c: F.lit(v) for c, v in counts.items()}) for df in (q, n))
    block = lambda ident, count: F.pmod(F.xxhash64(ident), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    qs = q.withColumn("_qb", block("_qid", "_qn")).withColumn("_nb", each("_nn"))
    ns = n.withColumn("_nb", block("_nid", "_nn")).withColumn("_qb", each("_qn"))
    return qs.drop("_qn", "_nn"), ns.drop("_qn", "_nn")


def _best(scores: np.ndarray, want: int, rank_of_id: np.ndarray, positive: bool) -> np.ndarray:
    """Positions of the ``want`` highest scores of a row, ties by id."""
    want = min(want, len(scores))
    if want <= 0:
        return np.empty(0, dtype=np.int64)
    floor = np.partition(scores, len(scores) - want)[len(scores) - want]
    cand = np.flatnonzero((scores >= floor) & (scores > 0) if positive else scores >= floor)
    return cand[np.lexsort((rank_of_id[cand], -scores[cand]))][:want]


def _ranks(ids: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(ids), dtype=np.int64)
    ranks[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return ranks


def _emit(left: pa.Table, first: np.ndarray, ids: pa.Array, ks: np.ndarray, scores: np.ndarray,
          group: list[str], positive: bool) -> pa.Table:
    """Best rows of a block: query i (a row number ``first[i]`` of left) against the node ids."""
    ranks = _ranks(ids.to_numpy(zero_copy_only=False))
    picks = [_best(scores[i], int(ks[i]), ranks, positive) for i in range(len(first))]
    at = np.repeat(np.arange(len(first)), [len(p) for p in picks])
    to = np.concatenate(picks) if picks else np.empty(0, dtype=np.int64)
    rows = left.select([*group, "_qid", "_k"]).take(pa.array(first[at]))
    return rows.append_column("_nid", ids.take(pa.array(to))).append_column("score", pa.array(scores[at, to]))


def score_block(left: pa.Table, right: pa.Table, group: list[str], digits: int) -> pa.Table:
    """Each query's best rows of a block by rounded cosine, ties by id. Only scores that can round to the k-th best are rounded."""
    ids = right.column("_nid").combine_chunks()
    if not left.num_rows or not right.num_rows:
        return _emit(left.slice(0, 0), np.empty(0, np.int64), ids, np.empty(0), np.zeros((0, right.num_rows)), group, False)
    queries, nodes, ks = _unit(_matrix(left, "_qv")), _unit(_matrix(right, "_nv")).T, left.column("_k").to_numpy()
    ranks, step = _ranks(ids.to_numpy(zero_copy_only=False)), 10.0 ** -digits
    at, to, kept = [], [], []
    for begin in range(0, len(queries), STRIP_ROWS):
        scores = queries[begin:begin + STRIP_ROWS] @ nodes
        for i, row in enumerate(scores, begin):
            want = min(int(ks[i]), len(row))
            if want <= 0:
                continue
            near = np.flatnonzero(row >= np.partition(row, len(row) - want)[len(row) - want] - step)
            rounded = np.round(row[near], digits)
            best = np.lexsort((ranks[near], -rounded))[:want]
            at.append(np.full(len(best), i))
            to.append(near[best])
            kept.append(rounded[best])
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    rows = left.select([*group, "_qid", "_k"]).take(pa.array(joined(at, np.int64)))
    return rows.append_column("_nid", ids.take(pa.array(joined(to, np.int64)))).append_column("score", pa.array(joined(kept, np.float64)))


def _merge(partial: DataFrame, group: list[str], query_id: str, node_id: str, score: str, max_k: int) -> DataFrame:
    """Best rows over all blocks; the literal ``max_k`` lets every task cut before the shuffle."""
    w = Window.partitionBy(*group, "_qid").orderBy(F.col("score").desc(), F.col("_nid"))
    return (partial.withColumn("_rn", F.row_number().over(w))
            .filter((F.col("_rn") <= max_k) & (F.col("_rn") <= F.col("_k")))
            .select(*group, F.col("_qid").alias(query_id), F.col("_nid").alias(node_id),
                    F.col("score").alias(score), F.col("_rn").cast("bigint").alias("rank")))


def _run(qs: DataFrame, ns: DataFrame, group: list[str], task) -> DataFrame:
    cells = [*group, "_qb", "_nb"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in qs.select(*group, "_qid", "_k").schema.fields) \
        + f", _nid {ns.schema['_nid'].dataType.simpleString()}, score double"
    return qs.groupBy(*cells).cogroup(ns.groupBy(*cells)).applyInArrow(task, ddl)


def cosine_topk(queries: DataFrame, nodes: DataFrame, group: list[str], query_id: str, node_id: str,
                query_vec: str, node_vec: str, k: str = "k", digits: int = 6,
                block_rows: int = BLOCK_ROWS, max_k: int | None = None) -> DataFrame:
    """(group, query_id, node_id, similarity, rank): per query the best ``k`` (a column of queries)
    nodes of its group, similarity rounded to ``digits``, ties by node id."""
    fresh = [F.col(g).alias(g) for g in group]        # both sides may come from one table
    q = queries.select(*fresh, F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qv"), F.col(k).alias("_k"))
    n = nodes.select(*fresh, F.col(node_id).alias("_nid"), F.col(node_vec).alias("_nv"))
    qs, ns = _cells(group, q, n, block_rows)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        return score_block(left, right, group, digits)

    if max_k is None:
        max_k = queries.agg(F.max(k)).first()[0] or 0
    return _merge(_run(qs, ns, group, task), group, query_id, node_id, "similarity", int(max_k))


def weighted_terms_topk(weights: DataFrame, postings: DataFrame, group: list[str], query_id: str, node_id: str,
                        k: int, digits: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, query_id, node_id, score, rank): best ``k`` nodes per query where the score is the best
    field's sum of query weight * node weight over shared terms.

    weights: group, query_id, field, term, w; postings: group, node_id, field, term, f. Only nodes
    sharing a term can appear."""
    fresh = [F.col(g).alias(g) for g in group]
    q = weights.select(*fresh, F.col(query_id).alias("_qid"), F.lit(k).alias("_k"),
                       *[F.col(c).alias(c) for c in ("field", "term", "w")])
    n = postings.select(*fresh, F.col(node_id).alias("_nid"),
                        *[F.col(c).alias(c) for c in ("field", "term", "f")])
    qs, ns = _cells(group, q, n, block_rows)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, first, q_at = np.unique(left.column("_qid").to_numpy(), return_index=True, return_inverse=True)
        n_ids, n_first, n_at = np.unique(right.column("_nid").to_numpy(), return_index=True, return_inverse=True)
        scores = np.zeros((len(q_ids), len(n_ids)))
        if left.num_rows and right.num_rows:
            for field in pc.unique(left.column("field")).to_pylist():
                mine = _by_term(left, field, q_at, "w")
                theirs = _by_term(right, field, n_at, "f")
                one = np.zeros_like(scores)
                for term in mine.keys() & theirs.keys():
                    (qi, w), (ni, f) = mine[term], theirs[term]
                    one[np.ix_(qi, ni)] += np.outer(w, f)
                np.maximum(scores, one, out=scores)
            scores = np.round(scores, digits)
        return _emit(left, first, right.column("_nid").take(pa.array(n_first)).combine_chunks(),
                     left.column("_k").to_numpy()[first], scores, group, True)

    return _merge(_run(qs, ns, group, task), group, query_id, node_id, "score", k)


def _by_term(table: pa.Table, field: str, at: np.ndarray, weight: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """term -> (row or column numbers, weights) of one field; a term occurs once per query or node."""
    mine = pc.equal(table.column("field"), field).to_numpy()
    rows = np.flatnonzero(mine)
    coded = table.column("term").combine_chunks().take(pa.array(rows)).dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(1, len(coded.dictionary)))
    values = table.column(weight).to_numpy()
    parts = np.split(rows[order], starts)
    return {t: (at[p], values[p]) for t, p in zip(coded.dictionary.to_pylist(), parts)}
