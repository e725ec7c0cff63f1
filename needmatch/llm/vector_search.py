"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its nearest pivots. The index deals all vectors into blocks; within a block
every pivot has an inverted file of (vector, place of the pivot in its order). A query reads the files of its own
nearest pivots, which adds up the footrule distance between the orders (a pivot missing on one side stands behind the
last place), keeps a share of the block with the smallest distance, ties included, and reranks it by exact cosine.
The best of all blocks are the answer.

Pivots are a bounded sample of the vectors (``pivots``, chosen by hash); every vector is indexed. Queries meet the
blocks in chunks: the work is queries x vectors x places / pivots table look-ups, and memory is one block and one chunk.

Defined results: null vectors, zero vectors and those with null or non-finite components take no part, nor those whose
length isn't the most common one; fewer candidates than k give fewer rows; equal scores go to the smaller id; repeated
rows of one id count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

PIVOTS = 128
PLACES = 64
BLOCK_ROWS = 8192
CHUNK_QUERIES = 4096
SHARE = 0.3


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0))
    return rows


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    return np.argsort(-(unit(rows) @ pivots.T), axis=1, kind="stable")[:, :places]


class InvertedFiles:
    """Postings of one block: for each pivot the rows that have it, and its place in their orders."""

    def __init__(self, orders: np.ndarray, pivots: int):
        self.rows, places = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.files = [((by_pivot[a:b] // places).astype(np.int32), (by_pivot[a:b] % places).astype(np.int32))
                      for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.places = places

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of each row's order from ``order``; rows that share no pivot are farthest."""
        distance = np.full(self.rows, self.places * (self.places + 1), np.int32)
        for place, pivot in enumerate(order.tolist()):
            rows, places = self.files[pivot]
            distance[rows] -= 2 * (self.places - np.maximum(places, place))
        return distance


def exact_cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    dots = (rows * query).sum(axis=1)
    return dots / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
           pivots: int = PIVOTS, places: int = PLACES, share: float = SHARE, block_rows: int = BLOCK_ROWS,
           chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """(query_id, rank, key, score): the k nearest vectors found for each query, never the query's own id."""
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows = materialize(usable(vectors, key, vector).dropDuplicates(["id"]), "vectors")
    asked = materialize(usable(queries, key, vector).dropDuplicates(["id"]), "query-vectors")
    out = spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    if lengths is None:
        return out.withColumnRenamed("id", key)
    rows, asked = (t.where(F.size("v") == lengths["length"]) for t in (rows, asked))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    centres = unit(np.array([r["v"] for r in sample]))
    places = min(places, len(centres))
    blocks = max(1, -(-lengths["n"] // block_rows))
    chunks = max(1, -(-asked.count() // chunk_queries))

    # every block meets every chunk of queries once
    placed = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "id", "v")
    posed = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                         F.pmod(F.xxhash64(F.lit("chunk"), "id"), F.lit(chunks)).cast("int").alias("chunk"), "id", "v")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, own = left["id"].to_numpy(), np.stack(left["v"].to_numpy())
            files = InvertedFiles(nearest_pivots(own, centres, places), len(centres))
            wanted = max(4 * k, int(np.ceil(share * len(ids)))) + 1
            theirs = np.stack(right["v"].to_numpy())
            orders = nearest_pivots(theirs, centres, places)
            for query, v, order in zip(right["id"].to_numpy(), theirs, orders, strict=True):
                distance = files.footrule(order)
                if wanted < len(ids):
                    near = np.flatnonzero(distance <= np.partition(distance, wanted - 1)[wanted - 1])
                else:
                    near = np.arange(len(ids))
                near = near[ids[near] != query]
                scores = exact_cosines(v, own[near])
                top = best(ids[near], scores, k)
                found.append(pd.DataFrame({"query_id": query, "id": ids[near][top], "score": scores[top]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "score": []})

    met = (placed.groupBy("block", "chunk").cogroup(posed.groupBy("block", "chunk"))
           .applyInPandas(meet, f"query_id {kind}, id {kind}, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(key), "score"))
