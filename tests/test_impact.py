"""Lists that end early, against sums of all entries."""

import random
from unittest import mock

import pytest
from pyspark.sql import functions as F

from needmatch.operators import search as se
from needmatch.plans import impact

ENTRY = "project_id string, field string, term string, node long, f double"
WEIGHT = "project_id string, query int, field string, term string, w double"


def lists(seed, nodes=3000, queries=6):
    r = random.Random(seed)
    entries, weights = [], []
    for t in range(12):
        often = [0.6, 0.3, 0.05, 0.01][t % 4]           # the commonest terms stand in most nodes
        for n in range(nodes):
            if r.random() < often:
                entries.append((f"p{n % 7 == 0}", "body", f"t{t}", n, round(2.2 * r.random() ** 6 + 1e-3, 3)))
            if r.random() < often / 20:
                entries.append((f"p{n % 7 == 0}", "title", f"t{t}", n, round(2.2 * r.random(), 2) + 1e-3))
    for q in range(queries):
        for t in r.sample(range(13), 5):                # t12 stands nowhere
            for field, boost in (("body", 3), ("title", 1)):
                weights.append((f"p{q == 0}", q, field, f"t{t}", boost * [0.4, 1.0, 3.0, 5.0][t % 4]))
    return entries, weights


def plain(entries, weights, group, k):
    by_term = {}
    for p, field, t, n, f in entries:
        by_term.setdefault((p if group else 0, field, t), []).append((n, f))
    sums = {}
    for p, q, field, t, w in weights:
        for n, f in by_term.get((p if group else 0, field, t), []):
            sums[q, n, field] = sums.get((q, n, field), 0) + w * f
    best = {}
    for (q, n, _), s in sums.items():
        best[q, n] = max(best.get((q, n), 0), round(s, 6))
    out = []
    for q in {q for q, _ in best}:
        own = sorted((-s, n) for (p, n), s in best.items() if p == q)
        out += [(q, n, i + 1) for i, (_, n) in enumerate(own[:k])]
    return sorted(out)


@pytest.mark.parametrize("group", [["project_id"], []])
@pytest.mark.parametrize(("k", "slices"), [(5, 1 << 17), (40, 20), (5000, 1 << 17)])
def test_exact(spark, group, k, slices, monkeypatch):
    monkeypatch.setattr(impact, "SLICE_ROWS", slices)
    entries, weights = lists(k)
    e, w = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(weights, WEIGHT)
    if not group:
        e, w = e.drop("project_id"), w.drop("project_id")
    found = impact.ListSearch(w, *impact.impact_bands(e, group, 2.2), group, k, 6).top()
    assert sorted((r["query"], r["node"], r["rank"]) for r in found.collect()) == plain(entries, weights, group, k)


def test_lists_end_early(spark):
    """Most entries of the common terms are never read."""
    entries, weights = lists(1, nodes=8000)
    e, w = (spark.createDataFrame(x, ddl).drop("project_id") for x, ddl in ((entries, ENTRY), (weights, WEIGHT)))
    search = impact.ListSearch(w, *impact.impact_bands(e, [], 2.2), [], 5, 6)
    r = search.bands_to_read().agg(F.sum("_rows").alias("all"), F.sum(F.when(F.col("_read"), F.col("_rows"))).alias("read")).first()
    assert r["read"] < 0.4 * r["all"]


def test_nothing(spark):
    e, w = spark.createDataFrame([], ENTRY), spark.createDataFrame(lists(1)[1], WEIGHT)
    assert impact.ListSearch(w, *impact.impact_bands(e, ["project_id"], 2.2), ["project_id"], 5, 6).top().count() == 0


def test_postings_of_words_a_project_does_not_ask_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a", "red red blue"), (2, "a", "blue green"), (3, "b", "red blue"), (4, "c", "red")], "doc_id long, project_id string, text string")
    queries = spark.createDataFrame([(1, "a", "red"), (2, "b", "blue")], "query_id long, project_id string, query string")
    read = []

    class Lists(impact.ListSearch):
        def __init__(self, weights, entries, *rest):
            read.extend((r["project_id"], r["term"], r["node"]) for r in entries.collect())
            super().__init__(weights, entries, *rest)

    with mock.patch.object(se, "ListSearch", Lists):
        found = se.bm25_search(queries, "query_id", "query", se.bm25_index(docs, "doc_id", ["text"]), se.field_stats(docs, ["text"]),
                               docs=docs.select("doc_id", "project_id"), lists=True)
        assert sorted((r["query_id"], r["doc_id"]) for r in found.collect()) == [(1, 1), (2, 3)]
    assert sorted(read) == [("a", "red", 1), ("b", "blue", 3)]
