"""Bounded samples of labelled rows, for fitting small models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize

MAX_LABELLED = 20_000


def remainder(key, modulus: int) -> F.Column:
    """crc32 of the key as text, modulo; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text",
                    max_rows: int = MAX_LABELLED) -> DataFrame:
    """(key, label, text) of at most ``max_rows`` labelled documents, chosen by a hash of their key; written once.

    The cut is made on (key, label) rows alone; of repeated labels the largest counts, null labels don't. A key gives one
    row, however many rows of ``docs`` have it: of its texts the one with the smallest hash.
    """
    chosen = (labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key"))
              .agg(F.max(label).cast("int").alias("label"))
              .where(F.col("key").isNotNull()).orderBy(F.xxhash64("key"), "key").limit(max_rows))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text")))     # partial minima before the shuffle
    sample = texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(own.alias("own"))
    return materialize(sample.select("key", "label", F.col("own.text").alias("text")), "labelled")
