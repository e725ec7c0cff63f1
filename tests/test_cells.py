"""Pruned exact search and the code index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from needmatch.operators import search as se
from needmatch.plans import cells as ce

DDL = "project_id string, vec_id long, embedding array<double>"


def clustered(seed, n=1600, d=24, spots=12, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(spots, d))
    x = centres[rng.integers(0, spots, n)] + spread * rng.normal(size=(n, d))
    x[7] = 0
    x[11] = x[10]
    return x


def frame(spark, x, groups=3):
    # the first group holds more than half of the rows
    return spark.createDataFrame([(f"g{max(0, i % 7 - 4) % groups}", i, v.tolist()) for i, v in enumerate(x)], DDL).repartition(4)


def exact(nodes, queries, k, threshold):
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    out = []
    for q in queries:
        near = sorted((-round(float(unit(np.array(q.embedding)) @ unit(np.array(n.embedding))), 6) + 0.0, n.vec_id)
                      for n in nodes if n.project_id == q.project_id)
        out += [(q.project_id, q.vec_id, i, -s, r + 1) for r, (s, i) in enumerate(near[:k]) if -s >= threshold]
    return sorted(out)


def rows_of(df):
    return sorted((r.project_id, r.query_id, r.vec_id, r.similarity + 0.0, r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("k", "threshold"), [(5, 0.5), (30, -1.0), (3, 0.999)])
def test_pruned_search_is_exact(spark, k, threshold):
    nodes = frame(spark, clustered(1)).cache()
    queries = nodes.where("vec_id % 40 in (0, 7)").withColumnRenamed("vec_id", "query_id")
    got = se.vector_topk(queries, nodes, ["project_id"], "query_id", "vec_id", k, threshold, block_rows=50)
    want = exact(nodes.collect(), nodes.where("vec_id % 40 in (0, 7)").collect(), k, threshold)
    got = rows_of(got)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[4] for g in got] == [w[4] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1.1e-6)


def test_pruning_skips_blocks(spark):
    nodes = frame(spark, clustered(2, 4000))
    queries = nodes.where("vec_id % 50 = 1").withColumnRenamed("vec_id", "query_id")
    r = se.block_pruning(queries, nodes, ["project_id"], "query_id", "vec_id", 10, 0.2, block_rows=200, cells=60).first()
    assert r.queries == 80 and r.scored_pairs < 0.3 * r.all_pairs


def test_one_group_and_columns_as_limits(spark):
    nodes = frame(spark, clustered(3, 500), groups=1)
    queries = nodes.where("vec_id % 50 = 3").select(F.col("vec_id").alias("query_id"), "embedding", (1 + F.col("vec_id") % 4).alias("k"),
                                                    F.lit(0.3).alias("t"))
    for group in ([], ["project_id"]):
        q = queries.withColumn("project_id", F.lit("g0"))
        both = [se.vector_topk(q, nodes, group, "query_id", "vec_id", "k", "t", pruned=p, block_rows=100).select("query_id", "vec_id", "similarity", "rank")
                for p in (True, False)]
        assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect()))


def test_code_index(spark, tmp_path):
    x = clustered(4, 3000, spots=40, spread=0.5)
    nodes = frame(spark, x).cache()
    queries = nodes.where("vec_id % 30 = 2").withColumnRenamed("vec_id", "query_id")
    index = ce.build_codes(nodes, ["project_id"], "vec_id", "embedding", block_rows=300)
    assert len(index.centres) == 23 and index.books.shape == (6, 256, 4)
    assert index.codes.count() == 3000 and index.codes.groupBy("project_id", "_cell", "_sub").count().agg(F.max("count")).first()[0] < 400
    index.save(str(tmp_path / "index"))
    stored = ce.CodeIndex.load(spark, str(tmp_path / "index"), ["project_id"])
    found = [se.vector_topk_ann(queries, nodes, ["project_id"], "query_id", "vec_id", 10, index=i) for i in (index, stored)]
    assert rows_of(found[0]) == rows_of(found[1])
    best = se.vector_topk(queries, nodes, ["project_id"], "query_id", "vec_id", 10, -1.0)
    recall = se.ann_recall(found[0], best, ["project_id"], "query_id", "vec_id").collect()
    assert sum(r.wanted for r in recall) == 1000 and all(r.recalled >= 0.95 * r.wanted for r in recall)


def test_codes_read_part_of_the_table(spark):
    """A query of a large group reads a small share of its codes; a group far away from the query is read further out."""
    x = clustered(5, 4000, spots=60, spread=0.1)
    x[0] = -x[1]
    nodes = spark.createDataFrame([("few" if i < 30 else "many", i, v.tolist()) for i, v in enumerate(x)], DDL)
    index = ce.build_codes(nodes, ["project_id"], "vec_id", "embedding", cells=60)
    q = nodes.where("vec_id % 100 = 0 or vec_id < 5").select("project_id", F.col("vec_id").alias("_qid"), F.col("embedding").alias("_qv"), F.lit(3).alias("_k"))
    probes = ce._probed(q, index, 4, 60).join(index.counts, ["project_id", "_cell"]).groupBy("project_id", "_qid").agg(F.sum("_n").alias("n")).collect()
    assert len(probes) == q.count()
    assert all(r.n == 30 if r.project_id == "few" else 60 <= r.n < 1200 for r in probes)


def test_no_rows(spark):
    nodes = frame(spark, clustered(6, 50))
    none = nodes.where("false")
    queries = nodes.limit(5).withColumnRenamed("vec_id", "query_id")
    assert se.vector_topk(queries, none, ["project_id"], "query_id", "vec_id", 3, 0.1).count() == 0
    assert se.vector_topk_ann(queries, none, ["project_id"], "query_id", "vec_id", 3).count() == 0
    assert se.vector_topk(queries.where("false"), nodes, ["project_id"], "query_id", "vec_id", 3, 0.1, pruned=True).count() == 0


@pytest.mark.parametrize(("spread", "pruned"), [(0.05, True), (50.0, False)])
def test_vectors_equally_far_are_scored_in_whole_blocks(spark, spread, pruned):
    """Bounds that rule out next to nothing don't send a vector to each block one by one; the rows stay exact."""
    nodes = frame(spark, clustered(8, 2000, d=32, spread=spread)).cache()
    queries = nodes.where("vec_id % 40 = 3").withColumnRenamed("vec_id", "query_id")
    q = se._limits(queries, 5, -1.0)
    found, pairs = se._pruned(q, nodes, ["project_id"], "query_id", "vec_id", "embedding", "embedding", 5, block_rows=40, cells=16)
    blocks = pairs.groupBy("project_id", "_qid").count().agg(F.avg("count")).first()[0]
    assert (blocks < 10) == pruned
    want = exact(nodes.collect(), nodes.where("vec_id % 40 = 3").collect(), 5, -1.0)
    got = sorted((r.project_id, r.query_id, r.vec_id, r["rank"]) for r in found.collect())
    assert got == [(w[0], w[1], w[2], w[4]) for w in want]


def test_codes_find_neighbours_that_are_equally_far(spark):
    x = np.random.default_rng(9).normal(size=(2500, 64))
    nodes = spark.createDataFrame([("all", i, v.tolist()) for i, v in enumerate(x)], DDL).cache()
    queries = nodes.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    best = se.vector_topk(queries, nodes, ["project_id"], "query_id", "vec_id", 10, -1.0)
    r = se.ann_recall(se.vector_topk_ann(queries, nodes, ["project_id"], "query_id", "vec_id", 10), best, ["project_id"], "query_id", "vec_id").first()
    assert r.wanted == 500 and r.recalled >= 0.95 * r.wanted
