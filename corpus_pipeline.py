"""From raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from needmatch.llm import jaccard_join, mixing, packing, quality_classifier, toxicity
from needmatch.session import materialize
from needmatch.sources.tables import read_table

#: Near copies of the pipeline share at least this part of their shingles of this many words; op6 has a measure of its own.
WIDTH = 5
PERCENT = 80


def unused(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    out = unused(docs, "verdict")
    judged = quality_classifier.score(docs, read_table(spark, sf_dir, "labels"), out=out)
    return judged.where(F.col(out)["kept"]).select(*docs.columns)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    lexicon = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    out = unused(docs, "toxicity")
    return toxicity.score(docs, lexicon, out=out).where(F.col(out) < toxicity.THRESHOLD).select(*docs.columns)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; of equal rows one."""
    content = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.struct("doc_id", content.alias("content")).alias("row"), "text")
    first = (jaccard_join.near_copies(rows, key="row", width=WIDTH, percent=PERCENT)
             .where(F.col("row").eqNullSafe(F.col("component_id")))
             .select(F.col("row.doc_id").alias("_id"), F.col("row.content").alias("_content")).distinct())
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    same = (F.col("row.doc_id").eqNullSafe(F.col("_id"))
            & (F.xxhash64(F.col("row.text").cast("string")) == F.col("_content")))
    return whole.join(first, same).dropDuplicates(["_id", "_content"]).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document may stand in several rows or none."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", good), ("toxicity", civil), ("n-gram Jaccard join", single), ("mixing", mixed),
          ("packing", packed)]
#: Tokenizers and fitted models can't be said in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again as the next one's."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
