"""The code index and the pruned search with blocks and parts so small that every step has several of them."""

from unittest import mock

import numpy as np
from pyspark.sql import functions as F

from needmatch.operators import search as se
from needmatch.plans import cells as ce

DDL = "project_id string, vec_id long, embedding array<double>"
rows = lambda df: sorted((r.project_id, r.query_id, r.vec_id, r.similarity, r["rank"]) for r in df.collect())


def test_small_blocks_give_the_same_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 900)] + 0.3 * rng.normal(size=(900, 16))
    x[5] = 0
    nodes = spark.createDataFrame([("b" if i % 9 == 8 else "a", i, v.tolist()) for i, v in enumerate(x)], DDL).cache()
    queries = nodes.where("vec_id % 12 in (0, 5)").withColumnRenamed("vec_id", "query_id")
    index = ce.build_codes(nodes, ["project_id"], "vec_id", "embedding", cells=20, block_rows=30)
    q = queries.select("project_id", F.col("query_id").alias("_qid"), F.col("embedding").alias("_qv"), F.lit(4).alias("_k"))
    near = ce.code_candidates(q, index, 200, 4, 32).collect()
    assert len(near) == q.count() and all(len(r["_nids"]) == 32 for r in near)              # one row a query, not one a pair
    ann = lambda: rows(se.vector_topk_ann(queries, nodes, ["project_id"], "query_id", "vec_id", 4, probes=4, rerank=32, index=index))
    exact = lambda: rows(se.vector_topk(queries, nodes, ["project_id"], "query_id", "vec_id", 4, 0.5, pruned=True, block_rows=40))
    whole = ann(), exact()
    with mock.patch.multiple(ce, TASK_CODES=150, RERANK_ROWS=64, QUERY_ROWS=16, TABLES=8, PAIR_ROWS=50, MOST_PAIR_ROWS=50):
        assert (ann(), exact()) == whole
    assert len({r[1] for r in whole[0]}) == q.count() and [r for r in whole[0] if r[1] == 5] == [("a", 5, i, None, n + 1) for n, i in enumerate(sorted(r[2] for r in whole[0] if r[1] == 5))]


def test_repeated_ids_and_missing_groups(spark):
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([("a" if i % 5 else None, i // 2, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))], DDL)
    queries = nodes.where("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    found = se.vector_topk_ann(queries, nodes, ["project_id"], "query_id", "vec_id", 3).collect()
    assert {r.project_id for r in found} == {"a"} and {r.query_id for r in found} == set(range(20))
    assert all(r.similarity == 1.0 and r.vec_id == r.query_id for r in found if r["rank"] == 1)


def test_one_group_without_a_key(spark):
    x = np.random.default_rng(6).normal(size=(300, 8))
    nodes = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], DDL).drop("project_id").cache()
    queries = nodes.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = se.vector_topk_ann(queries, nodes, [], "query_id", "vec_id", 5)
    best = se.vector_topk(queries, nodes, [], "query_id", "vec_id", 5, -1.0)
    r = se.ann_recall(found, best, [], "query_id", "vec_id").first()
    assert r.wanted == 75 and r.recalled >= 72
