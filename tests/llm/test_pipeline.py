"""The pipeline's stages on given and odd tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from needmatch.llm import toxicity
from needmatch.session import fresh_path

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, FOLDER)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
            break
        assert after.columns == columns and after.schema == before.schema
        path = fresh_path(spark, "stage")
        after.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.join(docs, columns, "left_anti").count() == 0
        if name != "mixing":
            assert after.count() == after.distinct().count() <= before.count()
        before = after


def test_single(spark, odd):
    docs = odd.withColumn("n_chars", F.length("text"))
    rows = corpus_pipeline.single(spark, docs, FOLDER).collect()
    ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 6, 8, 9, 11, 12, 13]


def test_single_against_brute_force(spark):
    texts = {}
    for n, edits in [(1000, 21), (1000, 22), (1000, 23), (500, 11), (500, 12), (120, 2), (120, 3)]:
        base = [f"w{n}x{edits}x{i}" for i in range(n)]
        copy = list(base)
        for k in range(edits):
            copy[(k + 1) * n // (edits + 1)] = f"new{k}"
        texts |= {len(texts): base, len(texts) + 1: copy}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    near = {i for i in texts if i % 2 and 100 * len(sets[i] & sets[i - 1]) >= 80 * len(sets[i] | sets[i - 1])}
    assert near == {1, 3, 7, 11}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.single(spark, docs, FOLDER).collect()}
    assert got == set(texts) - near


def test_clashing_names(spark):
    """Columns named like those that the stages use on the way pass through as they are."""
    names = ["verdict", "_verdict", "Toxicity", "_toxicity", "_id", "_content", "_key", "_copies", "_copy", "row", "content",
             "component_id"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, FOLDER)
        assert rows.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows.collect() for n in names)


def test_odd_and_empty_tables(spark, odd, bare, labels):
    folder = fresh_path(spark, "tables")
    labels.write.parquet(f"{folder}/labels.parquet")
    for docs in (odd, bare):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, folder).count() >= 0
    assert toxicity.fit(odd, labels).entries == []
